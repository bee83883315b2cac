"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

The model counts runs of ``ORDER`` characters in trusted texts.  Counts of
shorter runs are continuation counts, each order has three discounts from its
counts of counts, and the probability of a character is interpolated down to a
uniform one.

The counts stay in Spark tables, sharded by run.  Texts never cross the
network: each split of the documents (so many rows of a file, fewer of longer
texts) asks for its distinct runs only, the count tables of all orders are joined to the distinct
runs of the whole table, and each split gets the probabilities of its own runs
back as one file in the shared folder, against which its texts are scored.  A document is kept if its
perplexity is not above the quantile of its language among trusted documents
that the model has not seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm import files
from tillscope.llm.common import fresh_folder, pick, stored

ORDER = 5
#: Bits of a symbol in a packed run; five symbols fit a long.
BITS = 12
SYMBOLS = 1 << BITS
BEGIN, END, SPACE = 1, 2, 32
#: One trusted document in so many is kept from the counts and sets the thresholds.
HELD_OUT = 10
QUANTILE = 0.995
#: Characters worked on at once, and runs gathered before they are merged.
BLOCK = 1 << 20
GATHERED = 6_000_000
#: Rows of a file that make a split, and characters up to which a text counts as one row; both are powers of two.
SPLIT_ROWS = 8_192
ROW_CHARS = 32_768

# Symbols below DIRECT are the characters of that code point.  A character from there on is two symbols, a lead
# with its upper bits and a trail with its lower eleven, so that none shares its symbols with another.
DIRECT, TRAIL = 1_504, 2_048


def symbols(text: str) -> np.ndarray:
    """The text's characters as symbols, one or two each; white space is one symbol."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points[(points < 33) | (points == 0x85) | (points == 0xA0)] = SPACE
    wide = points >= DIRECT
    if not wide.any():
        return points
    out = np.empty(len(points) + np.count_nonzero(wide), np.int64)
    at = np.arange(len(points)) + np.cumsum(wide) - wide
    out[at] = np.where(wide, DIRECT + (points >> 11), points)
    out[at[wide] + 1] = TRAIL + (points[wide] & 2_047)
    return out


def text_runs(text: str | None) -> Iterator[np.ndarray]:
    """The runs that predict each symbol and the text's end, packed, in blocks."""
    text, before = text or "", np.full(ORDER - 1, BEGIN, np.int64)
    for at in range(0, len(text) + 1, BLOCK):
        after = np.full(int(at + BLOCK > len(text)), END, np.int64)
        own = np.concatenate([before, symbols(text[at:at + BLOCK]), after])
        runs = np.zeros(len(own) - ORDER + 1, np.int64)
        for k in range(ORDER):
            runs = (runs << BITS) | own[k:len(own) - ORDER + 1 + k]
        yield runs
        before = own[1 - ORDER:]


def length_class() -> Column:
    """How many times the text's length in rows of ``ROW_CHARS`` can be halved: 0 for most texts."""
    rows = F.greatest(F.lit(1), F.floor(F.length("text") / ROW_CHARS))
    return F.least(F.lit(SPLIT_ROWS.bit_length() - 1), F.coalesce(F.floor(F.log2(rows)), F.lit(0))).cast("int")


def split_key() -> Column:
    """A scanned row's split, by its file, its text's length class and its place in the file.

    Texts of a class share a split with fewer rows the longer they are, so a
    split has at most ``2 * SPLIT_ROWS * ROW_CHARS`` characters, or a single text.
    It does not depend on how Spark cuts the files into tasks, which follows
    the cores registered at planning time; so it is the same in every scan.
    """
    rows = F.expr(f"shiftright({SPLIT_ROWS}, class)")
    return F.xxhash64(F.col("_metadata.file_path"), "class", F.floor(F.col("_metadata.row_index") / rows))


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, list[int]]]:
    """``(split, common, rows)`` of a batch: splits of longer texts, then the common ones in the order of their rows.

    A common split goes on in the next batch, so it comes last.
    """
    split, common = batch.column("split").to_numpy(), batch.column("class").to_numpy() == 0
    for wanted in (False, True):
        rows = np.flatnonzero(common == wanted)
        rows = rows if wanted else rows[np.argsort(split[rows], kind="stable")]
        edges = np.flatnonzero(np.diff(split[rows])) + 1
        for own in np.split(rows, edges) if len(rows) else ():
            yield int(split[own[0]]), wanted, own.tolist()


def _to_files(rows: DataFrame, tag: str, columns: list[str]) -> str:
    """Write each split's rows as a file of arrays in a shared folder; returns the folder."""
    folder = fresh_folder(rows.sparkSession, tag)

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        table = pa.table({c: group[c].to_numpy() for c in columns})
        path = f"{folder}/{key[0]}"
        own = f"{path}.{uuid.uuid4().hex}"  # every attempt of a task has the same rows
        with files.create(own) as out, pa.ipc.new_file(out, table.schema) as sink:
            sink.write_table(table)
        files.publish(own, path)
        return pd.DataFrame({"split": [key[0]]})

    rows.select("split", *columns).groupBy("split").applyInPandas(write, "split long").write.format("noop").mode(
        "overwrite").save()
    return folder


def _from_file(folder: str, split: int, columns: list[str]) -> list[np.ndarray]:
    """Arrays of the split's file; every split has one, so a missing file raises."""
    with files.random_access(f"{folder}/{split}") as f:
        table = pa.ipc.open_file(f).read_all()
    return [table[c].to_numpy() for c in columns]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return distinct, total


def _trusted_in(folder: str, split: int) -> set[int]:
    ids, learn = _from_file(folder, split, ["doc_id", "learn"])
    return set(ids[learn].tolist())


class _Gathered:
    """Distinct runs of a split's texts, and how often its trusted texts have them."""

    def __init__(self):
        self.keys, self.counts, self.fresh, self.size = [], [], [], 0

    def add(self, text: str | None, trusted: bool) -> None:
        for runs in text_runs(text):
            self.fresh.append((runs, trusted))
            self.size += len(runs)
            if self.size >= BLOCK:
                self._gather()

    def _gather(self) -> None:
        for learn in (True, False):
            own = [r for r, t in self.fresh if t == learn]
            if own:
                run, n = np.unique(np.concatenate(own), return_counts=True)
                self.keys.append(run)
                self.counts.append(n if learn else np.zeros(len(run), np.int64))
        self.fresh, self.size = [], 0
        if sum(map(len, self.keys)) > GATHERED:
            run, n = _merged(self.keys, self.counts)
            self.keys, self.counts = [run], [n]

    def batches(self, split: int | None) -> Iterator[pa.RecordBatch]:
        """What was gathered, which then starts anew."""
        self._gather()
        if self.keys:
            run, n = _merged(self.keys, self.counts)
            self.keys, self.counts = [], []
            for at in range(0, len(run), 200_000):
                part = run[at:at + 200_000]
                yield pa.RecordBatch.from_pydict({"split": np.full(len(part), split), "run": part, "n": n[at:at + 200_000]})


def runs_by_split(rows: DataFrame, trusted_folder: str) -> DataFrame:
    """``split, run, n``: each split's distinct runs, and how often its trusted texts have them.

    Tasks that share a split each give its runs, with their own counts.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, trusted, gathered = None, set(), _Gathered()
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for split, common, own in _by_split(batch):
                if not common:
                    alone, ids = _Gathered(), _trusted_in(trusted_folder, split)
                    for n in own:
                        alone.add(texts[n].as_py(), docs[n] in ids)
                    yield from alone.batches(split)
                    continue
                if split != current:
                    yield from gathered.batches(current)
                    current, trusted = split, _trusted_in(trusted_folder, split)
                for n in own:
                    gathered.add(texts[n].as_py(), docs[n] in trusted)
        yield from gathered.batches(current)

    return rows.mapInArrow(count, "split long, run long, n long")


def _lower(order: int) -> int:
    return (1 << (BITS * order)) - 1


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The order's discounts for counts of 1, 2 and more."""
    n = counts.agg(*(F.count(F.when(F.col("a") == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))


def _discount(a: str, d: tuple) -> Column:
    return F.when(F.col(a) == 1, d[0]).when(F.col(a) == 2, d[1]).otherwise(d[2])


def log_probabilities(counts: DataFrame) -> DataFrame:
    """``run, logp`` for every distinct run of ``counts`` (``run, n``; n is 0 for runs of no trusted text).

    ``logp`` is the logarithm of the probability of a run's last symbol after
    the others.  Each order is a table of counts, one of context totals, and a
    table of the wanted runs' probabilities, joined by run.
    """
    seen = {ORDER: counts.where("n > 0").select("run", F.col("n").alias("a"))}
    asked = {ORDER: counts.select("run")}
    for m in range(ORDER - 1, 0, -1):
        shorter = F.col("run").bitwiseAND(F.lit(_lower(m))).alias("run")
        seen[m] = stored(seen[m + 1].select(shorter).groupBy("run").agg(F.count(F.lit(1)).alias("a")), f"counts-{m}")
        asked[m] = stored(asked[m + 1].select(shorter).distinct(), f"asked-{m}")
    probability = None
    for m in range(1, ORDER + 1):
        d = _discounts(seen[m])
        rest = sum((F.lit(d[k]) * F.col(f"c{k + 1}") for k in range(3)), F.lit(0.0))
        kinds = [F.count(F.when(F.col("a") == 1, 1)).alias("c1"), F.count(F.when(F.col("a") == 2, 1)).alias("c2"),
                 F.count(F.when(F.col("a") > 2, 1)).alias("c3")]
        own = asked[m].join(seen[m], "run", "left")
        kept = F.coalesce(F.col("a") - _discount("a", d), F.lit(0.0))
        if m == 1:
            total = seen[m].agg(F.sum("a").alias("total"), *kinds).first()
            if not total["total"]:
                probability = own.select("run", F.lit(1.0 / SYMBOLS).alias("p"))
            else:
                share = sum(d[k] * total[f"c{k + 1}"] for k in range(3)) / total["total"]
                probability = own.select("run", (kept / F.lit(float(total["total"])) + F.lit(share / SYMBOLS)).alias("p"))
        else:
            contexts = seen[m].groupBy(F.shiftright("run", BITS).alias("context")).agg(
                F.sum("a").alias("total"), *kinds).select("context", "total", (rest / F.col("total")).alias("share"))
            below = probability.select(F.col("run").alias("shorter"), F.col("p").alias("lower"))
            joined = own.withColumn("context", F.shiftright("run", BITS)).withColumn(
                "shorter", F.col("run").bitwiseAND(F.lit(_lower(m - 1)))).join(contexts, "context", "left").join(
                below, "shorter")
            probability = joined.select("run", F.when(F.col("total").isNull(), F.col("lower")).otherwise(
                kept / F.col("total") + F.col("share") * F.col("lower")).alias("p"))
        probability = stored(probability, f"probabilities-{m}")
    return probability.select("run", F.log("p").alias("logp"))


def perplexities(rows: DataFrame, folder: str) -> DataFrame:
    """``doc_id, lang, n_symbols, perplexity`` of the texts, from their splits' files of probabilities."""

    def probabilities(split: int) -> tuple[np.ndarray, np.ndarray]:
        table, logp = _from_file(folder, split, ["run", "logp"])
        order = np.argsort(table)
        return table[order], logp[order]

    def scored(text: str | None, table: np.ndarray, logp: np.ndarray) -> tuple[int, float]:
        size, total = 0, 0.0
        for runs in text_runs(text):
            distinct, n = np.unique(runs, return_counts=True)
            at = np.minimum(np.searchsorted(table, distinct), len(table) - 1)
            if not np.array_equal(table[at], distinct):
                raise ValueError("a split's file lacks runs of its texts; was the table changed meanwhile?")
            size, total = size + len(runs), total + float(logp[at] @ n)
        return size, float(np.exp(-total / size))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            texts, values = batch.column("text"), [(0, 0.0)] * batch.num_rows
            for split, common, own in _by_split(batch):
                if common and split != current:
                    current, held = split, probabilities(split)
                tables = held if common else probabilities(split)
                for n in own:
                    values[n] = scored(texts[n].as_py(), *tables)
            if values:
                sizes, found = zip(*values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(sizes, pa.int64()),
                                                  pa.array(found, pa.float64())],
                                                 ["doc_id", "lang", "n_symbols", "perplexity"])

    return rows.mapInArrow(score, "doc_id long, lang string, n_symbols long, perplexity double")


def _held_out(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % HELD_OUT == 0


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", quantile: float = QUANTILE, plain_scan: bool = False) -> DataFrame:
    """``doc_id, lang, n_symbols, perplexity, threshold, kept`` for every row.

    ``trusted`` has the ids of the trusted documents.  ``plain_scan`` says that
    ``docs`` is a table read from files as it is; any other is first written to
    the shared folder, so that its splits stay the same.

    * null text counts as empty (its end is the one symbol predicted);
    * rows with a null id are scored but never trusted; each row that repeats a
      trusted id is trusted;
    * the threshold is the ``quantile`` of the perplexities of the language's
      held-out trusted rows; a null language is one of its own, and a language
      without such rows takes the quantile of all; without any trusted rows every
      document is kept, with a null threshold;
    * equal perplexities fall on the same side, since the threshold itself is kept;
    * texts of any length are scored whole, in blocks; the longer, the fewer share a split;
    * an empty table gives an empty result; other columns are ignored.
    """
    table = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"))
    if not plain_scan:
        table = stored(table, "documents")
    rows = table.withColumn("class", length_class()).withColumn("split", split_key())
    ids = pick(trusted, doc_id=id_col).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    learn = rows.select("doc_id", "split").join(ids.where(~_held_out()), "doc_id", "left_semi").withColumn("learn", F.lit(True))
    # a row for every split, so that one without trusted documents has its file too
    every = rows.select("split").distinct().select(F.lit(0).cast("long").alias("doc_id"), "split", F.lit(False).alias("learn"))
    asked = stored(runs_by_split(rows, _to_files(learn.unionByName(every), "trusted", ["doc_id", "learn"])), "runs")
    counts = stored(asked.groupBy("run").agg(F.sum("n").alias("n")), "run-counts")
    answers = asked.select("split", "run").join(log_probabilities(counts), "run")
    scored = stored(perplexities(rows, _to_files(answers, "answers", ["run", "logp"])), "perplexities")

    sample = scored.join(ids.where(_held_out()), "doc_id", "left_semi")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = sample.groupBy(F.col("lang").alias("of")).agg(limit.alias("own_limit"))
    overall = sample.agg(limit).first()[0]
    judged = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["of"]), "left").withColumn(
        "threshold", F.coalesce("own_limit", F.lit(overall).cast("double")))
    return judged.select("doc_id", "lang", "n_symbols", "perplexity", "threshold",
                         F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
