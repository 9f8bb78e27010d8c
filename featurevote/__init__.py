"""Build and judge binary classifiers over large file collections and feature tables.

``sources``    scans: binary files, images, feature tables, saved models
``functions``  column expressions and the NumPy kernels that run inside Arrow batches
``operators``  DataFrame -> DataFrame steps: features, batches, votes, counts, metrics, sinks
``plans``      compositions: train, score, ensemble, evaluate, infer
"""
