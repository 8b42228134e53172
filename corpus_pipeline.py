"""The corpus pipeline: documents to packed token windows in five stages.

Each stage takes the documents that its predecessor kept and returns documents (the last one pieces of
windows). Between stages they are written as Parquet to the shared folder and read again, so a stage
that loses executors starts from a table. Columns beyond those of ``documents`` are left behind.

=============  ==================================================================================
quality        documents that the rule ensemble scores below 0.5 go
near_copies    of documents linked by 5-word shingles with a similarity of 0.8 or more one stays,
               that with the smallest doc_id; documents without words are linked with nothing
private        personal data is replaced by its kind in brackets
mixture        documents are repeated, cut or left out as the mix of sources takes them: a whole copy
               for each full pass, then as many words from the start as the last pass takes
windows        the texts are packed into windows of 2048 tokens; each piece has its ids and ``copy``, the
               number of the row it was cut from, as copies of a document share doc_id and start
=============  ==================================================================================

Null texts count as empty, repeated rows as copies; an empty table stays empty through all stages.
Documents without words leave with the mixture, as there is nothing of them to take.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tiffinlake.llm import mixing, ngram, packing, pii, rules
from tiffinlake.llm.common import SPACE, WORD, read, scratch, stored, text_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    model = rules.fit(docs, labels)
    return rules.scored(docs, model).where("predicted = 1").select(*COLUMNS)


def is_table(docs: DataFrame) -> bool:
    """Whether ``docs`` is columns of files as they are, so that a row's place in its file is its own."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def placed(docs: DataFrame) -> DataFrame | None:
    """The rows numbered by the numbers in their file's name and their place in it; None where that is no number of its own."""
    if not is_table(docs):
        return None
    name = r"regexp_extract(_metadata.file_name, '^part-([0-9]{1,6})-.*-c([0-9]{1,3})[^0-9]', %d)"
    part, piece = (F.expr(f"try_cast({name % i} as long)") for i in (1, 2))
    file = F.shiftleft(part, 42) + F.shiftleft(piece, 32)
    try:
        names = docs.select(F.col("_metadata.file_path").alias("path"), file.alias("file")).distinct()
        rows = docs.select("*", (file + F.col("_metadata.row_index")).alias("row"))
    except AnalysisException:  # files without such columns
        return None
    files, numbers = names.agg(F.count("*"), F.count_distinct("file")).first()
    return rows if files == numbers else None


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each that holds however files are cut for tasks.

    Tables as Spark writes them number their rows, with no copy of the texts; other rows are written as one first.
    """
    docs = docs.select(*COLUMNS)
    rows = placed(docs)
    return rows if rows is not None else stored(mixing.with_row(docs), "rows", keep=1)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scratch(spark):
        rows = numbered(docs)
        found = ngram.join_near(rows.select(F.col("row").alias("doc_id"), "text"), n=5, percent=80)
        found = stored(found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row"), "found")
        first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row"))
        kept = found.groupBy("component_id").agg(first["row"].alias("kept"))
        # The documents to leave out are few as a rule; kept as a table, Spark sees whether they are.
        gone = stored(found.join(kept, "component_id").where("row <> kept").select("row"), "gone", keep=1)
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.with_spans(docs.select(*COLUMNS), redacted="clean")
    clean = clean.withColumn("text", F.col("clean")).withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scratch(spark):
        rows = numbered(docs)
        mixed = stored(mixing.mix(rows).select("row", "doc_id", "source", "size", "taken"), "mixed")
        taken = stored(mixing.passes(mixed), "taken", keep=1)
    rules = taken.where("row is null").select(F.col("source").alias("of"), "passes", "upto")
    odd = taken.where("row is not null").select("row", "size", "taken")
    rows = rows.where(F.col("text").rlike(WORD)).withColumn("hash", mixing.order_hash())
    rows = rows.join(rules, F.col("source").eqNullSafe(F.col("of"))).join(odd, "row", "left")
    words = F.regexp_extract_all(text_of(), F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    rest = (F.col("taken") % F.col("size")).cast("int")
    whole = F.array_repeat("text", F.coalesce(F.expr("taken div size"), mixing.whole_passes()).cast("int"))
    start = F.when(rest > 0, F.array(F.array_join(F.slice(words, F.lit(1), rest), "")))
    copies = rows.select(
        "doc_id", "lang", "source", F.explode(F.concat(whole, F.coalesce(start, F.array().cast("array<string>")))).alias("text")
    )
    return copies.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("private", private),
    ("mixture", mixture),
    ("windows", windows),
]
#: The classifier's fit and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table ``documents``."""
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
