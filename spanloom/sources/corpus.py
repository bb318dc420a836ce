"""Reading annotated and raw articles.

A corpus file is one JSON object keyed by pmid, or one such object per line. A file of the first kind is one task
and one row while it is parsed, so keep large corpora as lines or as parquet.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schemas import ARTICLES_CSV, CORPUS_FILE

# Where the files of a split lie below the root, in order of reading.
TRAIN_FILES = {
    "gold": "Data/raw/Annotations/Train/gold_quality/json_format/train_gold.json",
    "silver_2025": "Data/raw/Annotations/Train/silver_quality/json_format/train_silver_2025.json",
    "silver": "Data/raw/Annotations/Train/silver_quality/json_format/train_silver.json",
    "bronze": "Data/raw/Annotations/Train/bronze_quality/json_format/train_bronze.json",
}
DEV_FILE = "Data/raw/Annotations/Dev/json_format/dev.json"
TEST_FILE = "Data/raw/Test/articles_test.json"


def parse_corpus(texts: DataFrame) -> DataFrame:
    """Articles (pmid, metadata, title, abstract, entities, relations, ..) of JSON texts in column `value`."""
    return texts.select(F.explode(F.from_json("value", CORPUS_FILE)).alias("pmid", "article")).select(
        "pmid", "article.*"
    )


def read_corpus(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    return parse_corpus(spark.read.text(path, wholetext=not lines))


def load_dataset(spark: SparkSession, split: str, root: str, lines: bool = False) -> DataFrame:
    """The dev or train articles as they are; the train files are put together without removing doubles.

    With `lines` every line of a file is an object of its own, so large files are split between tasks.
    """
    if split not in ("train", "dev"):
        raise ValueError(f"split must be train or dev, not {split}")
    files = [DEV_FILE] if split == "dev" else list(TRAIN_FILES.values())
    return read_corpus(spark, [f"{root}/{f}" for f in files], lines)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def override_tiers(articles: DataFrame, priority: list[str]) -> DataFrame:
    """One row per pmid: of the tiers it occurs in, the first in `priority`.

    max_by combines map-side, so a pmid with very many copies is no problem.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in priority]), F.col("tier"))
    row = F.struct("tier", *[c for c in articles.columns if c not in ("pmid", "tier")])
    return articles.groupBy("pmid").agg(F.min_by(row, rank).alias("row")).select("pmid", "row.*")


def load_documents(
    spark: SparkSession, split: str, root: str, priority: list[str] | None = None, lines: bool = False
) -> DataFrame:
    """Articles of dev, test or train. In train a pmid found in several files is taken from the first in `priority`:
    gold first by default, list(reversed(TRAIN_FILES)) lets the file read last win. Missing files are left out. `lines` as in load_dataset.
    """
    if split in ("dev", "test"):
        return read_corpus(spark, f"{root}/{DEV_FILE if split == 'dev' else TEST_FILE}", lines)
    found = {t: f"{root}/{f}" for t, f in TRAIN_FILES.items() if _exists(spark, f"{root}/{f}")}
    if not found:
        raise ValueError(f"no train file below {root}")
    parts = [read_corpus(spark, f, lines).withColumn("tier", F.lit(t)) for t, f in found.items()]
    return override_tiers(reduce(DataFrame.unionByName, parts), priority or list(TRAIN_FILES))


def read_articles_csv(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract) of a pipe-separated file with header; other columns are not read."""
    raw = spark.read.csv(path, sep="|", header=True, multiLine=True, quote='"', escape='"')
    return raw.select("pmid", "title", "abstract")


def parse_article_lines(lines: DataFrame) -> DataFrame:
    """(pmid, title, abstract) of pipe-separated records in column `value`, one each, quoted where needed."""
    options = {"sep": "|", "quote": '"', "escape": '"'}
    return lines.select(F.from_csv("value", ARTICLES_CSV, options).alias("row")).select("row.*")


def first_documents(articles: DataFrame, n: int) -> DataFrame:
    """The first n articles by pmid; all of them when n is 0."""
    return articles.orderBy("pmid").limit(n) if n else articles
