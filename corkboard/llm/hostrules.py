"""Host-level quality rules: failures of document rules by host, rates shrunk by an empirical beta prior, verdicts joined back.

A text is read once, for a few numbers. Each rule's failures are summed by host, with partial sums, so that a hot host is one
row a task. The hosts of a rule share a beta prior, fitted by moments to their own rates: a host of few documents keeps close to the
mean, one of many goes by what it shows. A host whose rate of a rule is above HOST_LIMIT is left out as a whole; in one whose rate
of a rule is above RULE_LIMIT, the documents that fail that rule are. What is rare in a host is let pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkboard.llm.common import row_blocks, small, stored, utf8
from corkboard.llm.kernels import _SPACE

#: Shrunk rates above which a host is left out, and above which its documents that fail a rule are.
HOST_LIMIT, RULE_LIMIT = 0.5, 0.05
WINDOW = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set from each bound to the next."""
    run = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(run[bounds])


def _numbered(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same number for the same bytes: data is cut in parts of the lengths, one after another."""
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return parts.dictionary_encode().indices.to_numpy().astype(np.int64)


def _repeated(words: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Whether each word is in a run of `width` words that its row has twice at least. Runs are numbered exactly, from those of
    half the width; width is a power of two."""
    found, step = words, 1
    while step < width and len(found) > step:
        pairs = found[:-step] * (found.max() + 1) + found[step:]
        found = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    if len(words) < width:
        return np.zeros(len(words), bool)
    starts = np.flatnonzero(rows[: len(found)] == rows[width - 1 :])
    if not len(starts):
        return np.zeros(len(words), bool)
    _, which, times = np.unique(found[starts] * (rows.max() + 1) + rows[starts], return_inverse=True, return_counts=True)
    starts = starts[times[which] > 1]
    change = np.zeros(len(words) + 1, np.int64)
    change[starts] += 1
    change[starts + width] -= 1  # starts are distinct
    return np.cumsum(change[:-1]) > 0


def counted(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each row of UTF-8 bytes."""
    n = len(offsets) - 1
    if not len(data):
        return {c: np.zeros(n, np.int64) for c in COUNTS}
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]  # a row's first byte begins a word whatever the row before ends with
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(offsets, starts, "right") - 1
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": _between(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _between(_SYMBOLS[data], offsets)}
    # lines without their ends; the line that a row's last line feed opens comes before the next row's first
    ends = np.flatnonzero(data == 10)
    at = np.concatenate([ends + 1, offsets[:-1]])
    owner = np.concatenate([np.searchsorted(offsets, ends, "right") - 1, np.arange(n)])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    line_bounds = np.append(at, len(data))
    lines = _numbered(data[data != 10], _between(data != 10, line_bounds))
    worded = _between(inside, line_bounds) > 0
    lines, owner = lines[worded], owner[worded]
    distinct = np.unique(owner * (len(lines) + len(at)) + lines)  # numbers are less than the number of lines
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct // (len(lines) + len(at)), minlength=n)
    if len(starts):
        inner = np.flatnonzero(begins[inside])
        words = _numbered(data[inside], np.diff(np.append(inner, int(inside.sum()))))
        out["n_repeat_words"] = np.bincount(rows[_repeated(words, rows, WINDOW)], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return out


def measured(docs: DataFrame, host: Column | str = "source") -> DataFrame:
    """(doc_id, host, COUNTS) of each row of docs. Words are runs of characters other than ASCII white space, word_chars their code
    points; n_lines are lines with a word, n_dup_lines those equal to an earlier one; n_repeat_words are words in runs of eight
    that the text has twice. A null text has nothing; null hosts are the host of the empty name."""

    def count(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            parts = [counted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_blocks(offsets)]
            columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], names=["doc_id", "host", *COUNTS])

    named = F.coalesce((F.col(host) if isinstance(host, str) else host).cast("string"), F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", named.alias("host"), "text")
    return slim.mapInArrow(count, f"doc_id {kind}, host string, {', '.join(f'{c} long' for c in COUNTS)}")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null for what is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated runs."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Failures of what hosts are judged by: the base rule; more than a symbol in ten words; more than three in ten lines that
    repeat an earlier one; more than three in twenty words in repeated runs."""
    return {
        "base": base_failed(), "symbols": 10 * F.col("n_symbols") > F.col("n_words"), "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "repeats": 100 * F.col("n_repeat_words") > 15 * F.col("n_words"),
    }


def hosts(found: DataFrame) -> DataFrame:
    """(host, n_docs, and for each rule its failures f_<rule> and shrunk rate r_<rule>) of measured documents.

    Of hosts with n documents and f failures each, N and F together, p = F / N: the spread of their rates, weighted by n, above what
    chance gives is c = (sum(f^2 / n) / N - p^2 - p (1 - p) (k - 1) / N) / (p (1 - p) (1 - sum(n^2) / N^2 - (k - 1) / N)) for k
    hosts. The prior weighs 1 / c - 1 documents of rate p, at least one document and at most N; a host's rate is
    (f + weight p) / (n + weight). One row of sums comes to the driver."""
    names = list(rules())
    by_host = stored(found.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(r).alias(f"f_{name}") for name, r in rules().items()]), "host-failures")
    n = F.col("n_docs").cast("double")
    sums = [F.count("*").alias("k"), F.sum("n_docs").alias("N"), F.sum(n * n).alias("nn")]
    for name in names:
        f = F.col(f"f_{name}").cast("double")
        sums += [F.sum(f).alias(f"F_{name}"), F.sum(f * f / n).alias(f"S_{name}")]
    t = by_host.agg(*sums).first()
    rates = {}
    for name in names:
        p, weight = prior(t["k"], t["N"] or 0, t["nn"] or 0.0, t[f"F_{name}"] or 0.0, t[f"S_{name}"] or 0.0)
        rates[f"r_{name}"] = (F.col(f"f_{name}") + F.lit(weight * p)) / (F.col("n_docs") + F.lit(weight))
    return by_host.withColumns(rates)


def prior(k: int, total: int, squares: float, failures: float, spread: float) -> tuple[float, float]:
    """The mean of the beta prior, and the number of documents that it weighs. Without documents, or where all or none fail,
    any weight gives the same rates; where hosts differ by no more than chance, it is the number of all documents."""
    p = failures / total if total else 0.0
    if p in (0.0, 1.0):
        return p, 1.0
    chance = (k - 1) / total
    room = p * (1 - p) * (1 - squares / total**2 - chance)
    over = (spread / total - p * p - p * (1 - p) * chance) / room if room > 1e-12 else 0.0
    return p, float(total) if over <= 1 / (total + 1) else max(1.0, 1 / over - 1)


def judged(docs: DataFrame, host: Column | str = "source", host_limit: float = HOST_LIMIT, rule_limit: float = RULE_LIMIT) -> DataFrame:
    """(doc_id, host, COUNTS, base_failed, host_rate, verdict, kept) of each row of docs. verdict is base for a failure of the base
    rule; else host where the host has a rate above host_limit; else the first of symbols, lines, repeats that the document fails
    and of which its host's rate is above rule_limit; else null, and only such documents are kept. host_rate is the greatest of the
    host's shrunk rates. Repeated and null ids are rows as others. An empty table gives none.

    Documents move as a few numbers each. Verdicts of hosts are broadcast where a count shows them few, else they join by a shuffle,
    in which a hot host is split by Spark's own handling of skew."""
    found = stored(measured(docs, host), "host-measures")
    told = stored(hosts(found), "host-rates")
    rates = [f"r_{name}" for name in rules()]
    told = told.select("host", F.greatest(*rates).alias("host_rate"), *rates[1:])
    verdict = F.when(base_failed(), "base").when(F.col("host_rate") > host_limit, "host")
    for name, failed in list(rules().items())[1:]:
        verdict = verdict.when(failed & (F.col(f"r_{name}") > rule_limit), name)
    met = found.join(small(told, 200_000), "host").withColumn("verdict", verdict)
    return met.select("doc_id", "host", *COUNTS, base_failed().alias("base_failed"), F.round("host_rate", 6).alias("host_rate"), "verdict", F.col("verdict").isNull().alias("kept"))
