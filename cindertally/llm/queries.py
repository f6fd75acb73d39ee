"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, table
from . import chat_queries, line_dedup, media_gif, ngram_join, packing, piece_lattice, quality_gam, quality_rules, sharding, token_counts, token_files


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of Jaccard similarity 0.8 over runs of five words."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeats of runs of lines of 50 words or more."""
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    text = F.col("kept_text")
    return done.select("doc_id", "n_lines", "n_removed", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op3_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded over the lattice of a public model's pieces, with digests of the ids."""
    done = piece_lattice.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return done.select("doc_id", "n_bytes", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "decodes")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency-ranked variable-length token files of all documents, read back."""
    return token_files.token_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), keeps_space=True, end_id=0)


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as GIF, read back."""
    return media_gif.text_as_gif(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a digest cache: filled by a first run, met by a second."""
    cache, docs, model = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")
    token_counts.fill(docs, cache, model)
    return token_counts.token_counts(docs, cache, model, limit=4096)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens, each source at its share of all tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, window=2048)


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target documents of the quality rules: what labels call good, less the quarter held out for reports."""
    labels = table(spark, sf_dir, "labels")
    return labels.filter((F.col("quality") == 1) & ~quality_gam.held_out(F.col("doc_id")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, likelihood ratio and verdict of all documents; the target is what labels call good."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal weight, and where a ninth would take them."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * 8, 1.0)


#: Words by the contract's pattern; sets as distinct 5-grams; links by counting shared ones; least reachable id.
OP1 = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.k + y.k - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(src, dst) AS (SELECT a, b FROM edge UNION SELECT r.src, e.b FROM reach r JOIN edge e ON e.a = r.dst)
SELECT d.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT src, min(dst) AS low FROM reach GROUP BY src) m ON m.src = d.doc_id
"""

#: Windows are the shortest runs of 50 words forwards or backwards from a line; lines of windows seen before go.
OP2 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS num FROM documents),
n AS (SELECT doc_id, num, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, words, row_number() OVER (PARTITION BY doc_id ORDER BY num) AS i,
       sum(words) OVER (PARTITION BY doc_id ORDER BY num) AS run FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l) WHERE words > 0),
win AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.run - a.run + a.words >= 50 GROUP BY 1, 2
  UNION SELECT a.doc_id, max(b.i) AS s, a.i AS e FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.run - b.run + b.words >= 50 GROUP BY a.doc_id, a.i),
c AS (SELECT w.doc_id, w.s, w.e, string_agg(n.body, chr(10) ORDER BY n.i) AS body FROM win w JOIN n ON n.doc_id = w.doc_id AND n.i BETWEEN w.s AND w.e GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM c),
gone AS (SELECT DISTINCT f.doc_id, n.num FROM f JOIN n ON n.doc_id = f.doc_id AND n.i BETWEEN f.s AND f.e WHERE f.k > 1),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.num) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.num) FILTER (WHERE g.num IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.num = l.num GROUP BY 1)
SELECT doc_id, n_lines, n_removed, strlen(text) AS n_bytes, sha256(text) AS text_sha256 FROM kept
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_line_dedup, op3_piece_lattice, op4_token_files, op5_gif_media, op6_token_counts, op7_packing, op8_quality_gam, op9_quality_rules, op10_sharding)
} | chat_queries.QUERIES
ORACLES: dict[str, str] = {"op1_ngram_join": OP1, "op2_line_dedup": OP2} | chat_queries.ORACLES
