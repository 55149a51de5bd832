"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte trigrams. What a document declares is weighed by how often such a declaration has
gone with each language; the prior is that of its host, smoothed to its address suffix and that to the whole
corpus. Those counts are grouped sums of soft decisions over all documents, without the document's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.hashing import constants
from tickloom.llm.shared import bounded_batches, hold, materialize, utf8

BLOCK = 1 << 18


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows, about so many, that the trigram model is fitted on, shared evenly by the languages. fewest: rows of a language that is
    modelled, languages: so many of them at most, those with most rows. buckets: of trigrams, a power of two. evidence: trigrams
    that a text counts for at most, as they depend on each other. strength: pseudo-counts of a parent's distribution. least: posterior below which a document is rejected."""

    sample: int = 4000
    fewest: int = 5
    languages: int = 256
    buckets: int = 1 << 15
    evidence: float = 60.0
    strength: float = 10.0
    least: float = 0.5


@dataclass(frozen=True)
class Model:
    """Log probabilities of each bucket by language."""

    languages: tuple[str, ...]
    table: np.ndarray = field(repr=False)


def _fold() -> np.ndarray:
    """Letters lower-cased, bytes beyond ASCII as they are, all else a space."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


FOLD = _fold()
_PLACES = [np.asarray(constants(61 + k, 256) >> np.uint64(20), np.uint32) for k in range(3)]


def trigrams(data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram that begins at each byte but the last two, and whether it has a letter."""
    own = FOLD[data]
    letter = own != 32
    index = (_PLACES[0][own[:-2]] ^ _PLACES[1][own[1:-1]] ^ _PLACES[2][own[2:]]) & np.uint32(buckets - 1)
    return index, letter[:-2] | letter[1:-1] | letter[2:]


def _blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK, "right")) - 1)
        yield a, b
        a = b


def log_likelihoods(data: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log probabilities by language, trigrams with a letter) of each text, over all of it."""
    n, kinds = len(bounds) - 1, len(model.languages)
    total, count = np.zeros((n, kinds)), np.zeros(n, np.int64)
    table = np.vstack([model.table, np.zeros((1, kinds), np.float32)])
    for first, last in _blocks(bounds):
        for k_from, k_to, at, to in _cut(bounds, first, last):
            part = data[at:to]
            if len(part) < 3:
                continue
            index, good = trigrams(part, len(model.table))
            index = np.where(good, index, len(model.table))
            own = np.clip(bounds[k_from : k_to + 1] - at, 0, len(part))
            begin, end = own[:-1], np.maximum(own[1:] - 2, own[:-1])
            full = end > begin
            if not full.any():
                continue
            cuts = np.empty(2 * int(full.sum()), np.int64)
            cuts[::2], cuts[1::2] = begin[full], end[full]
            cuts = cuts[:-1] if cuts[-1] >= len(index) else cuts
            where = np.flatnonzero(full) + k_from
            for j in range(kinds):
                total[where, j] += np.add.reduceat(table[:, j][index], cuts)[::2]
            count[where] += np.add.reduceat(good.astype(np.int64), cuts)[::2]
    return total, count


def _cut(bounds: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int, int, int]]:
    """A block's texts and bytes; a text longer than a block in overlapping pieces, so memory follows the block."""
    at, to = int(bounds[first]), int(bounds[last])
    if to - at <= 2 * BLOCK:
        yield first, last, at, to
    else:
        while at < to - 2:
            end = min(to, at + BLOCK)
            yield first, last, at, end
            at = end - 2


#: What a declaration that the model doesn't know counts as.
OTHER = "*"


def plain(label: Column) -> Column:
    """A language's label or declaration without its region, in small letters; null if nothing is left."""
    out = F.lower(F.trim(F.regexp_substr(label.cast("string"), F.lit("^[^-_]*"))))
    return F.when(out != "", out)


def fit(docs: DataFrame, settings: Settings = Settings(), label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Trigram frequencies by language over about settings.sample labelled rows, picked by a hash of their id.

    Labels count without their region, in small letters, as declarations do. The languages are counted over all rows; each gets an even share
    of the sample, so that a rare one is modelled too. Rows without a label, text or id are left out; a table without labels gives the one language und.
    The counts are summed by Spark; what reaches the driver is a row for each bucket and language.
    """
    buckets = settings.buckets
    rows = docs.select(plain(F.col(label_col)).alias("label"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).where("label is not null and text is not null and id is not null")
    known = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= settings.fewest).orderBy(F.desc("n"), "label").limit(settings.languages).collect()
    share = {r["label"]: min(1.0, settings.sample / len(known) / r["n"]) for r in known}
    bound = F.coalesce(*(F.when(F.col("label") == k, F.lit(int(x * (1 << 30)))) for k, x in share.items())) if share else F.lit(0)
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            counts: dict[str, np.ndarray] = {}
            for k, label in enumerate(batch.column(0).to_pylist()):
                part = data[bounds[k] : bounds[k + 1]]
                if len(part) >= 3:
                    index, good = trigrams(part, buckets)
                    counts[label] = counts.get(label, 0) + np.bincount(index[good], minlength=buckets)
            for label, own in counts.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_pydict({"label": [label] * len(at), "bucket": at.astype(np.int32), "n": own[at]})

    rows = chosen.select("label", "text").mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = tuple(sorted({r["label"] for r in rows})) or ("und",)
    table = np.full((buckets, len(languages)), 0.5)
    for r in rows:
        table[r["bucket"], languages.index(r["label"])] += r["n"]
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def _normal(columns: list[Column]) -> list[Column]:
    total = sum(columns[1:], columns[0])
    return [c / total for c in columns]


def identify(docs: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """(doc_id, language, posterior, text_language, declared, n_trigrams, accepted): one row per row of docs.

    declared, host and suffix are expressions over docs, each null where there is no such evidence, which then says nothing;
    a declared value counts by its part before "-", lower-cased, and those that the model doesn't know count as one value and are null in the result. posterior is rounded to six
    digits; ties go to the first language by name. A text without a trigram that has a letter (null, empty, digits) can't be
    identified: it is rejected, and its language is und. So is one whose best posterior is below settings.least. A null doc_id
    stays null, repeated rows count each, other columns are left alone. Long texts are read in blocks; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = model.languages
    kinds = len(names)
    none = F.lit(None).cast("string")
    said = plain(none if declared is None else declared)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.when(said.isNotNull(), F.when(said.isin(*names), said).otherwise(F.lit(OTHER))).alias("declared"),
        (none if host is None else F.lower(host.cast("string"))).alias("host"),
        (none if suffix is None else F.lower(suffix.cast("string"))).alias("suffix"),
    )
    evidence = settings.evidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            total, count = log_likelihoods(*utf8(batch.column(1)), model)
            scaled = total * (np.minimum(count, evidence) / np.maximum(count, 1))[:, None]
            scaled -= scaled.max(axis=1, keepdims=True)
            p = np.exp(scaled)
            p /= p.sum(axis=1, keepdims=True)
            columns = [batch.column(0), *(batch.column(k) for k in (2, 3, 4)), pa.array(count), *(pa.array(p[:, j]) for j in range(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "declared", "host", "suffix", "n", *(f"t{j}" for j in range(kinds))])

    schema = "doc_id long, declared string, host string, suffix string, n long, " + ", ".join(f"t{j} double" for j in range(kinds))
    seen = materialize(rows.mapInArrow(run, schema), "language-text")
    text = [F.col(f"t{j}") for j in range(kinds)]
    has = F.col("n") > 0

    # How each declaration goes with each language: a row for each of the model's languages.
    joint = {r["declared"]: r for r in seen.where(has & F.col("declared").isNotNull()).groupBy("declared").agg(*(F.sum(c).alias(f"s{j}") for j, c in enumerate(text))).collect()}
    values = (*names, OTHER)
    counts = np.array([[joint[d][f"s{j}"] if d in joint else 0.0 for j in range(kinds)] for d in values]) + 0.5
    given = counts / counts.sum(axis=0)
    says = []
    for j in range(kinds):
        says.append(F.coalesce(F.create_map(*[x for k, d in enumerate(values) for x in (F.lit(d), F.lit(float(given[k, j])))])[F.col("declared")], F.lit(1.0)))
    own = [F.col(f"p{j}") for j in range(kinds)]
    weighed = seen.select("*", *(c.alias(f"p{j}") for j, c in enumerate(_normal([t * s for t, s in zip(text, says, strict=True)]))))

    # Host counts; suffix and corpus counts are sums of those.
    hosts = weighed.where(has).groupBy("host", "suffix").agg(*(F.sum(p).alias(f"h{j}") for j, p in enumerate(own)))
    hosts = materialize(hosts, "language-hosts")
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(f"h{j}").alias(f"x{j}") for j in range(kinds)))
    world = hosts.agg(*(F.coalesce(F.sum(f"h{j}"), F.lit(0.0)).alias(f"w{j}") for j in range(kinds))).first()
    everywhere = np.array([world[f"w{j}"] for j in range(kinds)]) + 1.0
    everywhere /= everywhere.sum()
    hosts = hosts.join(suffixes.withColumnRenamed("suffix", "suffix_of"), F.col("suffix").eqNullSafe(F.col("suffix_of")), "left").drop("suffix_of")
    hosts = hosts.select(F.col("host").alias("host_of"), F.col("suffix").alias("suffix_of"), *(f"h{j}" for j in range(kinds)), *(f"x{j}" for j in range(kinds)))
    joined = weighed.join(hosts, F.col("host").eqNullSafe(F.col("host_of")) & F.col("suffix").eqNullSafe(F.col("suffix_of")), "left")

    def less(name: str, j: int) -> Column:
        """A count without the row's own share, which it holds if the row has text."""
        return F.greatest(F.coalesce(F.col(f"{name}{j}"), F.lit(0.0)) - F.when(has, own[j]).otherwise(0.0), F.lit(0.0))

    def level(name: str, parent: list[Column]) -> list[Column]:
        mine = [less(name, j) for j in range(kinds)]
        total = sum(mine[1:], mine[0])
        return [(m + settings.strength * p) / (total + settings.strength) for m, p in zip(mine, parent, strict=True)]

    flat = [F.lit(float(x)) for x in everywhere]
    by_suffix = [F.when(F.col("suffix").isNull(), f).otherwise(x) for f, x in zip(flat, level("x", flat), strict=True)]
    joined = joined.select("*", *(c.alias(f"b{j}") for j, c in enumerate(by_suffix)))
    parent = [F.col(f"b{j}") for j in range(kinds)]
    by_host = [F.when(F.col("host").isNull(), b).otherwise(x) for b, x in zip(parent, level("h", parent), strict=True)]
    joined = joined.select("*", *(c.alias(f"q{j}") for j, c in enumerate(_normal([p * c for p, c in zip(own, by_host, strict=True)]))))
    best = F.greatest(*(F.col(f"q{j}") for j in range(kinds))) if kinds > 1 else F.col("q0")

    def winner(prefix: str, top: Column) -> Column:
        return F.coalesce(*(F.when(F.col(f"{prefix}{j}") >= top, F.lit(names[j])) for j in range(kinds)))

    top_text = F.greatest(*text) if kinds > 1 else text[0]
    sure = has & (best >= settings.least)
    return joined.select(
        "doc_id",
        F.when(sure, winner("q", best)).otherwise(F.lit("und")).alias("language"),
        F.round(best, 6).alias("posterior"),
        F.when(has, winner("t", top_text)).otherwise(F.lit("und")).alias("text_language"),
        F.when(F.col("declared") != OTHER, F.col("declared")).alias("declared"),
        F.col("n").alias("n_trigrams"),
        sure.alias("accepted"),
    )


def keep_identified(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose doc_id was rejected and never accepted; all columns as they were, rows with a null doc_id stay."""
    gone = decisions.where("doc_id is not null").groupBy("doc_id").agg(F.max("accepted").alias("any")).where("not any").select(F.col("doc_id").alias("__tickloom_gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["__tickloom_gone"], "left_anti")


def page_evidence(html: str = "html", url: str = "url") -> dict[str, Column]:
    """declared, host, suffix and text expressions of a table of web pages."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    said = F.regexp_extract(F.col(html), r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1)
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]+;", " ")
    return {"declared": F.when(said != "", said), "host": host, "suffix": F.substring_index(host, ".", -1), "text": bare}
