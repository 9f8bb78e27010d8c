"""Fixed values. Results match the published ones only if these stay as they are."""

# Image geometry and channel normalisation.
IMAGE_HEIGHT = 224
IMAGE_WIDTH = 224
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

# Feature vector: 3 x 256 histogram bins, 12 statistics, zeros up to the full width.
HISTOGRAM_BINS = 256
FEATURE_WIDTH = 2048

# Classes. Feature tables store REAL as 1; the swapped map is the one some callers configure.
LABEL_TO_INT = {"REAL": 1, "FAKE": 0}
LABEL_TO_INT_SWAPPED = {"REAL": 0, "FAKE": 1}
LABEL_PATTERN = "/(REAL|FAKE)/"
SPLIT_PATTERN = "/(train|test)/"
FILE_GLOB = "*.jpg"

# Batches and expected sizes.
TRAIN_BATCHES = 5
SPLIT_WEIGHTS = (0.2, 0.2, 0.2, 0.2, 0.2)
SPLIT_SEED = 42
EXPECTED_TOTAL = 120_000
EXPECTED_TRAIN = 100_000

# Judging.
TARGET_ACCURACY = 0.85
TARGET_ACCURACY_FULL = 0.70
BASELINE_ACCURACY = 0.7671
VERDICT_HIGH = 0.85
VERDICT_MEDIUM = 0.70
CV_FOLDS = 3
CV_METRIC = "areaUnderROC"
TOP_IMPORTANCES = 10
