"""Scans, sinks, projections, unions, batches and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import stand_ins as S
from catalog.registry import query, table
from featurevote.functions import labels as L
from featurevote.functions.vectors import rounded_mean
from featurevote.operators import batches, counts, explore, prepare, sinks
from featurevote.sources import files, tables

# --- scans -----------------------------------------------------------------------------------


@query("SELECT vec_id, label FROM embeddings")
def scan_table(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/embeddings.parquet").select("vec_id", "label")


@query(f"{S.STORE} SELECT vec_id, label, split, batch FROM laid_out WHERE split = 'train' AND batch IN (1, 3)")
def scan_several_tables(spark, sf_dir):
    root = S.feature_store(spark, sf_dir)
    paths = [f"{root}/split=train/label={label}/batch={b}" for label in (0, 1) for b in (1, 3)]
    return tables.read_tables(spark, paths, base_path=root).select("vec_id", "label", "split", "batch")


@query(f"{S.STORE} SELECT vec_id, round(list_sum(features), 6) AS total FROM laid_out WHERE split = 'train'")
def scan_glob(spark, sf_dir):
    root = S.feature_store(spark, sf_dir)
    rows = tables.read_table(spark, f"{root}/split=train/*", base_path=root)
    total = F.aggregate(F.col("features"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(total, 6).alias("total"))


@query(f"{S.STORE} SELECT vec_id, label, batch FROM laid_out WHERE split = 'train' AND batch <= 2")
def scan_first_batches(spark, sf_dir):
    rows = tables.read_batches(spark, S.feature_store(spark, sf_dir), split="train", max_batch=2)
    return rows.select("vec_id", "label", "batch")


@query(f"""{S.STORE} SELECT batch, count(*) AS n_rows FROM laid_out
WHERE split = 'train' AND batch IN (1, 2) GROUP BY batch""")
def scan_existing_tables(spark, sf_dir):
    root = S.feature_store(spark, sf_dir)
    paths = [f"{root}/split=train/label={label}/batch={b}" for label in (0, 1) for b in (1, 2, 99)]
    found = tables.read_existing_tables(spark, paths)
    # The key alone gives the batch back: the directories named it, the files do not.
    return batches.batch_sizes(batches.with_batch(found, "vec_id"))


@query()
def scan_files(spark, sf_dir):
    """Name and size of every file of the input folder, from metadata only; `scan_files_by_name` reads
    and checks bytes, on small files."""
    return files.read_files(spark, sf_dir).select(L.path_segment(F.col("path")).alias("name"), "length")


@query("""SELECT lang, sum(strlen(text) + 1)::BIGINT AS total_bytes, sum(strlen(text) + 1)::BIGINT AS bytes_read
FROM documents GROUP BY lang""")
def scan_files_by_name(spark, sf_dir):
    """Texts written as plain files by language, scanned back as bytes below all folders."""
    root = _text_files(spark, sf_dir)
    found = files.read_files(spark, root, name_glob="*.txt", recursive=True)
    lang = F.regexp_extract("path", "/lang=([a-z]+)/", 1)
    return found.groupBy(lang.alias("lang")).agg(
        F.sum("length").alias("total_bytes"),
        F.sum(F.length("content")).alias("bytes_read"),
    )


@query()
def scan_first_files(spark, sf_dir):
    found = files.read_first_files(spark, f"{sf_dir}/*.parquet", 10)
    return found.select(L.path_segment(F.col("path")).alias("name"), "length")


@query("""SELECT lang, source, sum(strlen(text) + 1)::BIGINT AS length, sum(strlen(text) + 1)::BIGINT AS bytes_read
FROM documents GROUP BY lang, source ORDER BY lang, source LIMIT 10""")
def first_text_files(spark, sf_dir):
    """The first ten of the text files by language and source, in path order; no other file is opened."""
    root = sinks.shared_folder(spark)
    texts = table(spark, sf_dir, "documents").select("lang", "source", "text")
    texts.repartition("lang", "source").write.partitionBy("lang", "source").text(root)
    found = files.read_first_files(spark, root, 10, name_glob="*.txt", recursive=True)
    lang, origin = (F.regexp_extract("path", f"/{name}=([a-z0-9]+)/", 1) for name in ("lang", "source"))
    return found.select(lang.alias("lang"), origin.alias("source"), "length", F.length("content").cast("bigint").alias("bytes_read"))


@query(f"""{S.VOTES}, long AS (UNPIVOT (SELECT label, pred_1, pred_2, pred_3, pred_4, pred_5 FROM votes)
  ON pred_1, pred_2, pred_3, pred_4, pred_5 INTO NAME model VALUE prediction),
{S.sql_metrics("long", "label", "prediction", "model")}
SELECT replace(model, 'pred_', 'model_') AS model, round(accuracy, 6) AS accuracy,
       round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       round(hard_auc, 6) AS auc_roc, 0.0::DOUBLE AS training_time_seconds, n_rows AS training_samples
FROM metrics""")
def metric_rows_explicit_schema(spark, sf_dir):
    """One metric row per model, brought back as a table under the explicit schema."""
    from featurevote.operators.confusion import hard_vote_metrics

    names = ("accuracy", "precision", "recall", "f1_score", "auc_roc")
    rows = hard_vote_metrics(S.model_predictions(spark, sf_dir), by=["model"]).collect()
    return tables.metrics_table(
        spark, [(r["model"], *[round(r[n], 6) for n in names], 0.0, r["n_rows"]) for r in rows]
    )


@query(f"""{S.VOTED}, {S.sql_metrics("voted", "label", "ensemble_prediction")}
SELECT round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score, n_rows FROM metrics""")
def metric_rows_inferred(spark, sf_dir):
    from featurevote.plans.ensemble import ensemble_metrics

    row = ensemble_metrics(S.voted(spark, sf_dir)).first()
    values = {"accuracy": round(row["accuracy"], 6), "f1_score": round(row["f1_score"], 6)}
    return tables.local_table(spark, [values | {"n_rows": row["n_rows"]}])


def _text_files(spark, sf_dir):
    root = sinks.shared_folder(spark)
    texts = table(spark, sf_dir, "documents").select("lang", "text")
    texts.write.mode("overwrite").partitionBy("lang").text(root)
    return root


# --- sinks -----------------------------------------------------------------------------------


@query(f"""{S.STORE} SELECT split, label, batch, count(*) AS n_input, count(*) AS n_saved, true AS ok
FROM laid_out GROUP BY split, label, batch""")
def write_batches_verified(spark, sf_dir):
    return sinks.write_batches_verified(S.laid_out(spark, sf_dir), sinks.shared_folder(spark))


@query(f"""{S.STORE} SELECT split, label, batch, count(*) AS n_saved,
       (SELECT count(*) FROM laid_out) AS n_written, (SELECT count(*) FROM laid_out) AS total_saved,
       true AS ok
FROM laid_out GROUP BY split, label, batch""")
def write_verified(spark, sf_dir):
    return sinks.write_verified(S.laid_out(spark, sf_dir), sinks.shared_folder(spark))


@query(f"""{S.STORE} SELECT (SELECT count(*) FROM (SELECT DISTINCT split, label, batch FROM laid_out)) AS ok_batches,
       (SELECT count(*) FROM (SELECT DISTINCT split, label, batch FROM laid_out)) AS n_batches,
       count(*) AS n_samples FROM laid_out""")
def batch_run_summary(spark, sf_dir):
    return counts.batch_run_summary(write_batches_verified(spark, sf_dir))


IS_DAMAGED = "split = 'train' AND label = 1 AND batch = 2"


@query(f"""{S.STORE} SELECT split, label, batch, NOT ({IS_DAMAGED}) AS was_ok, true AS is_ok, {IS_DAMAGED} AS rewritten
FROM laid_out GROUP BY split, label, batch""")
def rewrite_damaged_batch(spark, sf_dir):
    """One batch gets other values in as many rows; it is found by its checksum and alone written again."""
    rows = S.laid_out(spark, sf_dir)
    path, manifest, seen, places = (sinks.shared_folder(spark) for _ in range(4))
    sinks.write_with_manifest(rows, path, manifest)
    other = rows.where(IS_DAMAGED).withColumn("features", F.transform("features", lambda x: x + F.lit(1.0).cast("float")))
    other.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*sinks.FEATURE_LAYOUT).parquet(path)
    sinks.write_table(sinks.check_batches(spark, path, manifest).withColumnRenamed("ok", "was_ok"), seen)

    def files_of_batches(name: str):
        return spark.read.parquet(path).groupBy(*sinks.FEATURE_LAYOUT).agg(
            F.sort_array(F.collect_set("_metadata.file_path")).alias(name)
        )

    sinks.write_table(files_of_batches("before"), places)
    now = sinks.rewrite_batches(rows, path, manifest).withColumnRenamed("ok", "is_ok")
    keys = list(sinks.FEATURE_LAYOUT)
    moved = spark.read.parquet(places).join(files_of_batches("after"), keys)
    moved = moved.select(*keys, (F.col("before") != F.col("after")).alias("rewritten"))
    return spark.read.parquet(seen).join(now, keys).join(moved, keys)


@query(f"{S.PREDICTIONS} SELECT vec_id, label, prediction, round(score, 6) AS score FROM predictions")
def save_predictions(spark, sf_dir):
    path = sinks.shared_folder(spark)
    columns = ("vec_id", "label", "prediction", "score")
    sinks.save_predictions(S.predictions(spark, sf_dir), path, columns)
    return spark.read.parquet(path).withColumn("score", F.round("score", 6))


@query(f"""{S.VOTED} SELECT vec_id, label, pred_1, pred_2, pred_3, pred_4, pred_5, ensemble_prediction
FROM voted""")
def save_votes(spark, sf_dir):
    """The detailed vote table, written together with the final one."""
    final, detailed = sinks.shared_folder(spark), sinks.shared_folder(spark)
    sinks.save_votes(S.voted(spark, sf_dir).drop("vote_share"), final, detailed)
    return spark.read.parquet(detailed)


@query(f"{S.VOTED} SELECT label, ensemble_prediction, count(*) AS n FROM voted GROUP BY ALL")
def save_final_votes(spark, sf_dir):
    final, detailed = sinks.shared_folder(spark), sinks.shared_folder(spark)
    sinks.save_votes(S.voted(spark, sf_dir), final, detailed)
    saved = spark.read.parquet(final)
    return saved.groupBy("label", "ensemble_prediction").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang AS label, 'raw' AS split, sum(strlen(text) + 1)::BIGINT AS source_bytes,
       sum(strlen(text) + 1)::BIGINT AS target_bytes, true AS complete
FROM documents GROUP BY lang""")
def ingest_files(spark, sf_dir):
    """Text files by language copied into a table of bytes, then both sides compared."""
    source, target = _text_files(spark, sf_dir), sinks.shared_folder(spark)
    label, split = F.regexp_extract("path", "/lang=([a-z]+)/", 1), F.lit("raw")
    sinks.ingest_files(spark, source, target, "*.txt", split=split, label=label)
    raw = files.read_files(spark, source, "*.txt", recursive=True)
    raw = raw.withColumns({"split": split, "label": label})
    checked = sinks.verify_ingest(raw, sinks.read_ingested(spark, target))
    return checked.select("label", "split", "source_bytes", "target_bytes", "complete")


LONGEST_FILE = 30_000


@query(f"""WITH f AS (SELECT lang, source, sum(strlen(text) + 1)::BIGINT AS length FROM documents GROUP BY lang, source)
SELECT lang, source, length, CASE WHEN length <= {LONGEST_FILE} THEN length END AS bytes,
       CASE WHEN length > {LONGEST_FILE} THEN 'too long' END AS error,
       count(*) OVER () AS total_files, (sum(length) OVER ())::BIGINT AS total_size,
       count(*) FILTER (length > {LONGEST_FILE}) OVER () AS failed_files
FROM f""")
def ingest_with_failures(spark, sf_dir):
    """One text file for each language and source, of which long ones cannot be taken: status of every file,
    and the statistics of the run."""
    source, target = sinks.shared_folder(spark), sinks.shared_folder(spark)
    texts = table(spark, sf_dir, "documents").select("lang", "source", "text")
    texts.repartition("lang", "source").write.partitionBy("lang", "source").text(source)
    lang, origin = (F.regexp_extract("path", f"/{name}=([a-z0-9]+)/", 1) for name in ("lang", "source"))
    stats = sinks.ingest_files(spark, source, target, "*.txt", split=lang, label=origin, max_bytes=LONGEST_FILE)
    status = sinks.ingest_status(spark, source, target, "*.txt", max_bytes=LONGEST_FILE)
    told = [F.lit(stats[name]).cast("bigint").alias(name) for name in ("total_files", "total_size", "failed_files")]
    return status.select(lang.alias("lang"), origin.alias("source"), "length", "bytes", "error", *told)


@query("""WITH s AS (SELECT lang, source, count(*) AS source_files, sum(n_chars)::BIGINT AS source_bytes
  FROM documents GROUP BY ALL),
t AS (SELECT lang, source, count(*) AS target_files, sum(n_chars)::BIGINT AS target_bytes
  FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT lang, source, coalesce(source_files, 0) AS source_files, coalesce(source_bytes, 0) AS source_bytes,
       coalesce(target_files, 0) AS target_files, coalesce(target_bytes, 0) AS target_bytes,
       coalesce(source_files, 0) = coalesce(target_files, 0)
         AND coalesce(source_bytes, 0) = coalesce(target_bytes, 0) AS complete
FROM s FULL JOIN t USING (lang, source)""")
def verify_ingest(spark, sf_dir):
    """All documents against the labeled ones, by language and source."""
    source = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    target = source.join(table(spark, sf_dir, "labels").select("doc_id"), on="doc_id", how="inner")
    return sinks.verify_ingest(source, target, ("lang", "source"), "n_chars")


# --- projections, predicates, scalar functions ------------------------------------------------


@query(f"{S.VOTES} SELECT vec_id AS row_id, label, pred_1 FROM votes")
def select_and_alias(spark, sf_dir):
    return S.predictions(spark, sf_dir).select(
        F.col("vec_id").alias("row_id"), "label", F.col("prediction").alias("pred_1")
    )


@query("""SELECT doc_id, quality = toxic AS same, (quality + toxic)::INTEGER AS total,
       (quality + toxic) / 2.0::DOUBLE AS half FROM labels""")
def derived_columns(spark, sf_dir):
    total = F.col("quality") + F.col("toxic")
    return (
        table(spark, sf_dir, "labels")
        .withColumn("same", F.col("quality") == F.col("toxic"))
        .withColumn("total", total)
        .withColumn("half", total / 2.0)
        .select("doc_id", "same", "total", "half")
    )


@query("SELECT doc_id, 1 AS label FROM documents")
def constant_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.constant_label(1).alias("label"))


@query("SELECT page_id, regexp_extract(url, '/(en|es)/', 1) AS label FROM pages")
def label_from_path(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return prepare.with_label(pages, "url", S.PATH_PATTERN).select("page_id", "label")


@query("""SELECT page_id, CASE l WHEN 'en' THEN 1 WHEN 'es' THEN 0 END AS label,
       CASE WHEN l IN ('en', 'es') THEN l END AS name
FROM (SELECT page_id, regexp_extract(url, '/(en|es)/', 1) AS l FROM pages)""")
def label_map(spark, sf_dir):
    name = L.label_from_path(F.col("url"), S.PATH_PATTERN)
    rows = table(spark, sf_dir, "pages").select(
        "page_id", L.label_to_int(name, S.PATH_LABELS).alias("label")
    )
    return rows.withColumn("name", L.int_to_label(F.col("label"), S.PATH_LABELS))


@query("SELECT page_id, regexp_extract(url, '/(en|es)/', 1) AS label FROM pages WHERE regexp_matches(url, '/(en|es)/')")
def valid_rows(spark, sf_dir):
    labeled = prepare.with_label(table(spark, sf_dir, "pages"), "url", S.PATH_PATTERN)
    checked = labeled.withColumn("is_valid", F.col("label") != "")
    return prepare.valid_rows(checked).select("page_id", "label")


@query("SELECT doc_id, round((quality + toxic) / 2.0::DOUBLE) AS vote FROM labels")
def half_up_rounding(spark, sf_dir):
    vote = rounded_mean([F.col("quality"), F.col("toxic")])
    return table(spark, sf_dir, "labels").select("doc_id", vote.alias("vote"))


@query("""SELECT page_id, string_split(url, '/')[-1] AS name, string_split(url, '/')[-2] AS folder,
       CASE WHEN contains(url, '/en/') THEN 'en' ELSE 'other' END AS tag FROM pages""")
def path_attributes(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        L.path_segment(url, 1).alias("name"),
        L.path_segment(url, 2).alias("folder"),
        L.tag_if_contains(url, "/en/", "en", "other").alias("tag"),
    )


@query(f"SELECT page_id, {S.sql_hash('url')} AS row_hash FROM pages")
def row_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", L.key_hash(F.col("url")).alias("row_hash"))


# --- counts ----------------------------------------------------------------------------------


@query(f"""{S.STORE}, n AS (SELECT split, batch, count(*) AS n_rows FROM laid_out GROUP BY ALL)
SELECT e.split, e.batch::INTEGER AS batch, coalesce(n_rows, 0) AS n_rows
FROM (SELECT unnest(['train', 'test']) AS split) s
JOIN (SELECT unnest(range(1, 8)) AS batch, 'train' AS split UNION ALL
      SELECT unnest(range(1, 8)), 'test') e USING (split)
LEFT JOIN n ON n.split = e.split AND n.batch = e.batch""")
def batch_counts(spark, sf_dir):
    """Rows of the seven expected batches of either split; batches 6 and 7 do not exist."""
    wanted = spark.createDataFrame(
        [(s, b) for s in ("train", "test") for b in range(1, 8)], "split string, batch int"
    )
    store = tables.read_table(spark, S.feature_store(spark, sf_dir))
    return counts.counts_against_expected(store, wanted, ["split", "batch"])


@query("""SELECT count(*) AS actual, 120000::BIGINT AS expected, count(*) - 120000 AS difference,
       count(*) = 120000 AS complete FROM embeddings""")
def compare_total(spark, sf_dir):
    return counts.compare_total(batch_counts(spark, sf_dir))


@query("""SELECT count(*) AS actual, CASE WHEN count(*) >= 100000 THEN 'enough'
       WHEN count(*) > 0 THEN 'partial' ELSE 'empty' END AS band FROM lineitem""")
def total_band(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return counts.total_band(batches.batch_sizes(lines, "l_linestatus"))


@query(f"WITH {S.FEATURE_ROWS} SELECT label, count(*) AS count FROM feature_rows GROUP BY label ORDER BY label")
def label_distribution(spark, sf_dir):
    return counts.label_distribution(S.feature_rows(spark, sf_dir))


@query("""SELECT lang, source, count(*) AS n_rows,
       round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share
FROM documents GROUP BY lang, source""")
def dataset_overview(spark, sf_dir):
    overview = explore.dataset_overview(table(spark, sf_dir, "documents"), ["lang", "source"])
    return overview.withColumn("share", F.round("share", 6))


@query()
def file_sizes(spark, sf_dir):
    return explore.file_sizes(files.read_files(spark, sf_dir))


# --- order, union, batches -------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY ALL ORDER BY ALL")
def total_sort(spark, sf_dir):
    sizes = batches.batch_sizes(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return sizes.orderBy("l_returnflag", "l_linestatus")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 10")
def first_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(10)


@query(f"WITH {S.FEATURE_ROWS} SELECT vec_id, label FROM feature_rows")
def union_two(spark, sf_dir):
    rows = S.feature_rows(spark, sf_dir).select("vec_id", "label")
    return batches.union_all([rows.where("label = 1"), rows.where("label = 0")])


@query(f"{S.STORE} SELECT vec_id, batch FROM laid_out")
def union_many(spark, sf_dir):
    root = S.feature_store(spark, sf_dir)
    parts = [tables.read_batches(spark, root).where(F.col("batch") == b) for b in range(1, 6)]
    return batches.union_all(parts).select("vec_id", "batch")


@query(f"SELECT event_id, ({S.sql_hash('event_id')} % 5 + 1)::INTEGER AS batch FROM events")
def stable_batches(spark, sf_dir):
    return batches.with_batch(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("SELECT 5::BIGINT AS n_batches, count(*) AS n_rows, count(*) AS n_keys FROM events")
def random_batches(spark, sf_dir):
    """Five seeded random batches together hold every row once."""
    parts = batches.random_batches(table(spark, sf_dir, "events").select("event_id"))
    tagged = [p.withColumn("batch", F.lit(i)) for i, p in enumerate(parts, 1)]
    per_key = (
        batches.union_all(tagged)
        .groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("batch").alias("batch"))
    )
    return (
        per_key.groupBy("batch")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
        .agg(
            F.count(F.lit(1)).alias("n_batches"),
            F.sum("n").alias("n_rows"),
            F.sum("keys").alias("n_keys"),
        )
    )


@query(f"""SELECT ({S.sql_hash('o_orderkey')} % 5 + 1)::INTEGER AS batch, count(*) AS n_rows
FROM orders GROUP BY 1""")
def batch_sizes(spark, sf_dir):
    return batches.batch_sizes(batches.with_batch(table(spark, sf_dir, "orders"), "o_orderkey"))


@query(f"""SELECT o_orderkey, o_orderstatus, ((row_number() OVER (
  PARTITION BY o_orderstatus ORDER BY {S.sql_hash('o_orderkey')}, o_orderkey) - 1) % 7 + 1)::INTEGER AS batch FROM orders""")
def quota_batches(spark, sf_dir):
    """Seven batches of orders that differ by one row at most in each status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return batches.quota_batches(orders, "o_orderkey", 7, by=["o_orderstatus"])


@query(f"""{S.STORE} SELECT vec_id, label, batch FROM laid_out WHERE batch <= 1""")
def size_preset(spark, sf_dir):
    return batches.first_batches(S.laid_out(spark, sf_dir), 1).select("vec_id", "label", "batch")


@query("""SELECT o_orderpriority AS batch, count(DISTINCT o_orderstatus) AS n_classes, count(*) AS n_rows,
       count(DISTINCT o_orderstatus) > 1 AS trainable FROM orders GROUP BY 1
UNION ALL
SELECT 'only ' || o_orderstatus, 1, count(*), false FROM orders GROUP BY o_orderstatus""")
def classes_per_batch(spark, sf_dir):
    """Mixed batches by priority beside batches that hold one class each."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "label")
    mixed = orders.select("label", F.col("o_orderpriority").alias("batch"))
    single = orders.select("label", F.concat(F.lit("only "), "label").alias("batch"))
    return batches.classes_per_batch(batches.union_all([mixed, single]))
