"""Token counts through a digest cache.

A cache is a Parquet folder of (content, tokenizer, n_tokens): the SHA-256 of the normalised
content and that of the tokenizer's file and options. Counting joins the documents' digests to
it; only one document of each missing content is encoded, and its count is appended. Texts and what
is missing meet by a join on (content, doc_id): Spark broadcasts what is missing where that is little.

Content is normalised by `coalesce(text, '')` alone: any other change could change a count.

Cases: null counts as empty (0 tokens). Repeated texts and rows are encoded once and counted
for each row. Null doc_ids are kept. An empty table gives an empty result and appends nothing.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import stored
from .columns import sliced, small_batches

CACHE = "content string, tokenizer string, n_tokens long"


@lru_cache(maxsize=4)
def counter(path: str):
    """The library's counter for a tokenizer file, one per worker process."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def version(path: str) -> str:
    """Digest of the tokenizer's file and of how it is called here."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens|no truncation").hexdigest()


def cached(cache: DataFrame | None, tokenizer: str, like: DataFrame) -> DataFrame:
    """content, n_tokens of one tokenizer; once each, even where two jobs have appended the same."""
    if cache is None:
        return like.sparkSession.createDataFrame([], CACHE).select("content", "n_tokens")
    own = cache.filter(F.col("tokenizer") == tokenizer).select("content", "n_tokens")
    # rows as they are keep a join on hot contents splittable; only a cache with repeats needs the sum
    repeats = own.groupBy("content").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return own.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")) if repeats else own


def read_cache(docs: DataFrame, cache_path: str) -> DataFrame | None:
    """The cache, or None where there is none yet."""
    try:
        return docs.sparkSession.read.schema(CACHE).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text (normalised), content and n_bytes of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))


def fill(docs: DataFrame, cache_path: str, tokenizer_path: str) -> None:
    """Appends the counts of the contents that the cache lacks."""
    name = version(tokenizer_path)
    small_batches(docs.sparkSession)
    keyed = digests(docs).withColumn("key", F.coalesce("doc_id", F.lit(-1)))
    # one document stands for each missing content; rows carry digests, not texts
    missing = keyed.select("content", "key").join(cached(read_cache(docs, cache_path), name, docs).select("content"), "content", "left_anti").groupBy("content").agg(F.min("key").alias("key"))
    missing = stored(missing, "counts-missing", compression="zstd")
    if not missing.limit(1).count():
        return  # no text is read, shuffled or encoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        last = None
        for whole in batches:
            for batch in sliced(whole, "text"):
                contents = batch.column("content").to_pylist()
                new = [k for k, c in enumerate(contents) if c != (contents[k - 1] if k else last)]  # equal rows lie together
                last = contents[-1] if contents else last
                texts = batch.column("text").take(pa.array(new, pa.int64())).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([contents[k] for k in new], pa.string()), pa.array(count(texts), pa.int64())], ["content", "n_tokens"])

    # a row that stands twice may be counted in two tasks: equal contents have equal counts
    fresh = keyed.select("content", "key", "text").join(missing, ["content", "key"], "left_semi").select("content", "text").mapInArrow(run, "content string, n_tokens long").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select("content", F.lit(name).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for all docs; misses are appended to the cache first."""
    fill(docs, cache_path, tokenizer_path)
    counts = cached(read_cache(docs, cache_path), version(tokenizer_path), docs)
    keyed = digests(docs).select("doc_id", "content", "n_bytes")
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
