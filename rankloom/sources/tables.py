"""Parquet scans, the tables derived from the driver's fixtures, sinks and contracts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import shipped, written


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A scan that reads only the named columns."""
    shipped(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Bytes of files up to which a scan may be dealt anew over the cores.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small scan over all cores, where its few files give fewer tasks than that; a larger one as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table_profile(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """table, n_rows, n_columns; row counts come from file footers."""
    rows = None
    for name in names:
        df = table(spark, sf_dir, name)
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


# --- entities of the search domain, from the driver's tables -----------------


def first_tokens(column: str, n: int, chars: int = 1000):
    """The first n tokens, from the text's start alone where that holds more than n of them."""
    start = T.tokenize(F.substring(column, 1, chars))
    return F.array_join(F.when(F.size(start) > n, F.slice(start, 1, n)).otherwise(F.slice(T.tokenize(column), 1, n)), " ")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"]))
    category = F.expr("case lang when 'en' then 1 when 'es' then 2 when 'fr' then 3 when 'de' then 4 else 0 end")
    return docs.select(
        F.col("doc_id").alias("item_id"),
        first_tokens("text", 8).alias("title"),
        F.concat_ws(" ", "lang", "source").alias("params"),
        F.col("text").alias("description"),
        category.cast("long").alias("category"),
        F.substring("source", 4, 10).cast("long").alias("location"),
        F.when(F.col("doc_id") % 7 != 0, 1 + (F.col("doc_id") % 9) / 2.0).alias("rating"),
        (F.col("n_chars") % 50).alias("reviews"),
        F.col("n_chars").alias("price"),
        (F.col("doc_id") % 2).alias("phone_hidden"),
        (F.col("doc_id") % 3 == 0).cast("long").alias("message_forbidden"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark", ["item_id", "text"])
    key = F.col("item_id")
    return rows.select(
        key.alias("query_key"),
        first_tokens("text", 6).alias("search_query"),
        (key % 5).alias("category"),
        (key % 20).alias("location"),
        (key % 10 == 9).cast("long").alias("delivery"),
        F.when(key % 4 == 0, "рейтинг 3,5").otherwise("").alias("filters"),
    )


#: Passages that one pass over the documents looks for.
PASSAGES = 20_000


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_key, item_id: documents that hold the query's whole passage; found once, however often it is read.

    One pass over the documents finds up to ``PASSAGES`` passages at once with an
    automaton of all of them; more take further passes.
    """
    q = table(spark, sf_dir, "benchmark", ["item_id", "text"]).filter(F.length("text") > 0)
    docs = spread(table(spark, sf_dir, "documents", ["doc_id", "text"])).filter("text is not null")
    passes = max(1, -(-q.count() // PASSAGES))
    out = None
    for k in range(passes):
        some = q if passes == 1 else q.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in some.collect()])
        found = docs.mapInArrow(_finder(shared), "query_key long, item_id long")
        out = found if out is None else out.unionByName(found)
    return written(out, "relevant")


def _finder(shared):
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        keys: dict[str, list[int]] = {}
        for key, passage in shared.value:
            keys.setdefault(passage, []).append(key)
        automaton = ahocorasick.Automaton()
        for passage, ids in keys.items():
            automaton.add_word(passage, (passage, ids))
        automaton.make_automaton()
        for batch in batches:
            q, d = [], []
            if keys:
                for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                    for ids in {p: ids for _, (p, ids) in automaton.iter(text)}.values():
                        q += ids
                        d += [doc] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64())], names=["query_key", "item_id"])

    return run


def passage_vectors(spark: SparkSession, sf_dir: str, n_items: int = 100) -> DataFrame:
    """passage_id, item_id and vector; several passages an item."""
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return rows.select(F.col("vec_id").alias("passage_id"), (F.col("vec_id") % n_items).alias("item_id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).select(F.col("vec_id").alias("query_key"), F.col("embedding").alias("qvector"))
    return queries(spark, sf_dir).join(rows, "query_key")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a click: query_norm, item_id, category, location."""
    lines = table(spark, sf_dir, "lineitem", ["l_partkey"])
    parts = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        T.clean("p_name").alias("query_norm"), F.col("l_partkey").alias("item_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("location")
    )


# --- rankings in their stored form --------------------------------------------


def parse_rankings(df: DataFrame, channels: list[str], key: str = "query_key") -> DataFrame:
    """Wide, space-joined lists to query_key, channel, item_id (string), rank; null and empty lists give nothing."""
    entries = F.array(*[F.struct(F.lit(c).alias("channel"), F.filter(F.split(F.coalesce(F.trim(c), F.lit("")), " +"), lambda x: x != "").alias("ids")) for c in channels])
    long = df.select(F.col(key).alias("query_key"), F.explode(entries).alias("x"))
    return long.select("query_key", "x.channel", F.posexplode("x.ids").alias("rank", "item_id")).select("query_key", "channel", "item_id", (F.col("rank") + 1).alias("rank"))


def serialize_rankings(ranked: DataFrame, column: str = "answer") -> DataFrame:
    """query_key and its item ids in order of rank, joined by spaces."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"].cast("string"))
    return ranked.groupBy("query_key").agg(F.array_join(listed, " ").alias(column))


def ranking_check(ranked: DataFrame, corpus: DataFrame, query_keys: DataFrame, most: int = 250) -> DataFrame:
    """One row of integrity counts over all rankings; all but the first two should be 0."""
    per = ranked.groupBy("query_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("d"))
    sums = per.agg(
        F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("n_repeated"),
        F.coalesce(F.sum((F.col("n") > most).cast("long")), F.lit(0)).alias("n_too_long"),
    )
    foreign = ranked.join(corpus.select("item_id"), "item_id", "left_anti").agg(F.count(F.lit(1)).alias("n_foreign"))
    missing = query_keys.select("query_key").join(ranked, "query_key", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    return sums.join(foreign).join(missing)  # three single rows


def answer_check(answers: DataFrame, corpus: DataFrame, key: str = "query_key", exactly: int | None = 50, id_pattern: str = r"^\S+$") -> DataFrame:
    """query_key, ok: one row a query, well-formed unique ids of the corpus, the right number."""
    ids = F.filter(F.split(F.coalesce("answer", F.lit("")), " "), lambda x: x != "")
    rows = answers.select(F.col(key).alias("query_key"), ids.alias("ids"))
    rows = rows.withColumn("n", F.size("ids")).withColumn("rows", F.lit(1))
    known = rows.select("query_key", F.explode("ids").alias("item_id")).join(corpus.select(F.col("item_id").cast("string")), "item_id", "left_semi")
    known = known.groupBy("query_key").agg(F.count(F.lit(1)).alias("n_known"))
    size_ok = (F.col("n") == exactly) if exactly else F.col("n").between(1, 50)
    per = rows.groupBy("query_key").agg(
        F.sum("rows").alias("rows"), F.first("n").alias("n"),
        F.min((F.forall("ids", lambda x: x.rlike(id_pattern)) & (F.size(F.array_distinct("ids")) == F.size("ids")) & size_ok).cast("int")).alias("form"),
    )
    ok = (F.col("rows") == 1) & (F.col("form") == 1) & (F.coalesce("n_known", F.lit(0)) == F.col("n"))
    return per.join(known, "query_key", "left").select("query_key", ok.alias("ok"))


# --- sinks ----------------------------------------------------------------------


def write_answers(answers: DataFrame, path: str) -> None:
    """query_id, answer as CSV with a header, one file (a row a query)."""
    answers.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2, sort_keys=True)


def read_report(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
