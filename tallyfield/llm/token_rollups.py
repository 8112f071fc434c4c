"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change is a set of signed rows: what holds from now on counts plus one, what held before counts minus one, so an insert,
a delete and a revised count are all sums, and a batch's effect is one aggregate over its signed rows. Sums are combined
before the shuffle, so a source with a third of all rows costs no more than a small one.

A rollup is a folder with one small table per committed batch. A batch counts once its table is complete (the writer's
success file); committing a batch that is complete already does nothing, and one that broke off is written anew. Totals
are the sum over all complete batches and do not depend on their order.

Defined cases: a missing text has no tokens; missing sources and languages are values of their own; rows without an id
count like others in every batch, but the corpus rollup's last batch, which keeps the smallest id of each text, takes them
out; repeated rows count one by one; totals of zero documents and zero tokens vanish; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import SPACE_CLASS, words_of
from tallyfield.session import materialised, work_path

KEYS = ("source", "lang", "tokenizer")

# One run of letters, digits and other non-ASCII characters, or one ASCII mark.
PIECE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"


def word_count(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def piece_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PIECE)).cast("long")


TOKENIZERS = {"words-1": word_count, "pieces-1": piece_count}


def counted(docs: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """A row per document and tokenizer version: `doc_id`, `source`, `lang`, `tokenizer`, `tokens`."""
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), c.cast("long").alias("tokens")) for name, c in counts.items()])
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("t")).select("doc_id", "source", "lang", "t.tokenizer", "t.tokens")


def bpe_counted(docs: DataFrame, path: str | None = None, version: str = "word_bpe_49k") -> DataFrame:
    """The same rows for a tokenizer file, by the encoder of this subpackage."""
    from tallyfield.llm.word_bpe import encoded

    counts = encoded(docs, path, with_ids=False).select("doc_id", F.col("n_tokens").alias("tokens"))
    kept = docs.select("doc_id", "source", "lang")
    return kept.join(counts, "doc_id").select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).alias("sign"), "tokens")


def deletes(rows: DataFrame) -> DataFrame:
    """Rows that held before and no longer do, with the counts they held."""
    return rows.select(*KEYS, F.lit(-1).alias("sign"), "tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose counts or groups change."""
    return deletes(before).union(inserts(after))


class Rollup:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of the complete batches."""
        if not self._files.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._root)]
        return sorted(n.removeprefix("batch-") for n in names if self._complete(n))

    def _complete(self, name: str) -> bool:
        return self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write the batch's sums; False, and nothing happens, if the batch has been committed before."""
        name = f"batch-{batch}"
        if self._complete(name):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        sums.where("documents <> 0 OR tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/{name}")
        return True

    def totals(self) -> DataFrame:
        batches = [f"{self.path}/batch-{b}" for b in self.committed()]
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")


def without_repeated_lines(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def corpus_rollup(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Totals of a corpus after its life so far.

    All documents arrive with word counts; a second tokenizer version is added for all; documents with repeated lines are
    cut to distinct lines and revised, a batch that is delivered twice; copies of a text are deleted, the smallest id
    stays.
    """
    spark = docs.sparkSession
    text = F.col("text")
    edited = without_repeated_lines(text)
    columns = [f(t).alias(f"{side}_{name}") for name, f in TOKENIZERS.items() for side, t in (("old", text), ("new", F.col("edited")))]
    base = docs.select("doc_id", "source", "lang", "text", edited.alias("edited"))
    state = materialised(base.select("doc_id", "source", "lang", F.sha2(text, 256).alias("print"), *columns), "token-state")
    of = lambda side, *names: counted(state, {n: F.col(f"`{side}_{n}`") for n in names})
    both = tuple(TOKENIZERS)
    rollup = Rollup(spark, path or work_path(spark, "rollup"))
    rollup.commit("1-load", inserts(of("old", "words-1")))
    rollup.commit("2-second-tokenizer", inserts(of("old", "pieces-1")))
    changed = state.where(" OR ".join(f"`old_{n}` <> `new_{n}`" for n in both))
    pair = [counted(changed, {n: F.col(f"`{side}_{n}`") for n in both}) for side in ("old", "new")]
    for _ in range(2):
        rollup.commit("3-distinct-lines", revisions(*pair))
    first = state.groupBy("print").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rollup.commit("4-copies", deletes(of("new", *both).join(first, "doc_id", "left_anti")))
    return rollup.totals()


ROLLUP_SQL = f"""
WITH kept AS (
    SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents
    WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)
),
lines AS (
    SELECT doc_id, row_no, source, lang, line, min(i) AS i FROM (
        SELECT doc_id, row_no, source, lang, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT *, row_number() OVER () AS row_no, string_split(text, chr(10)) AS l FROM kept)
    ) GROUP BY ALL
),
edited AS (SELECT row_no, source, lang, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY row_no, source, lang),
counts AS (
    SELECT source, lang, 'words-1' AS tokenizer,
        len(list_filter(string_split_regex(text, '{SPACE_CLASS}+'), lambda x: x <> '')) AS tokens
    FROM edited
    UNION ALL
    SELECT source, lang, 'pieces-1', len(regexp_extract_all(text, '{PIECE}')) FROM edited
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM counts GROUP BY ALL
"""
