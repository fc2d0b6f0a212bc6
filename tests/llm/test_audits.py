"""Host rules, filter audit and importance resampling against plain loops, on odd rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corkboard.llm import filteraudit, hostrules, importance

SCHEMA = "doc_id long, text string, source string, host string, mask int, score string, row string, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéZ") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["漢字", "#tag", "50%", "<b>", "ẞx", "a b"]
    texts = []
    for _ in range(150):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
        lines += rng.choices(lines, k=rng.randint(0, 3))
        texts.append(rng.choice(["\n", "\r\n", "\n\n", "\n \n"]).join(lines) + rng.choice(["", "\n", " "]))
    texts += [None, "", " \t\n", "one", "x\n\nx\nx \n", " ".join(["same"] * 40), " ".join(vocabulary * 8), "\n".join(["one two three four"] * 9), "a" * 300_000, " ".join(rng.choice(vocabulary) for _ in range(60_000))]
    out = [(i, t, [None, "", "s1", "s2", "hot", "hot", "hot"][i % 7]) for i, t in enumerate(texts)]
    out += [(1000 + i, texts[i % 5], "hot") for i in range(40)] + [(None, texts[0], "s1"), (None, texts[0], "s1"), (None, None, None), (3, texts[3], "s2"), (3, texts[3], "s1"), (3, "another", "s1"), (1001, texts[1], "hot"), (1001, texts[1], "hot")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "clash", 0, "clash", "clash", "clash") for i, t, s in rows()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def test_host_measures(docs):
    found = hostrules.measured(docs).collect()
    want = Counter((i, s or "", *measures(t)) for i, t, s in rows())
    assert Counter(tuple(r) for r in found) == want


def test_host_measures_in_blocks():
    """Rows next to each other in a block don't join their words, lines or runs."""
    texts = ["a b c d e f g h", "a b c d e f g h", "", "\n", "x\n", "x", "a b c d e f g h a b c d e f g h", "é\né\n\né"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = hostrules.counted(data, offsets)
    assert list(zip(*[found[c].tolist() for c in hostrules.COUNTS], strict=True)) == [measures(t) for t in texts]


def test_verdicts(docs, empty):
    """Each verdict follows from the shrunk rates, which a plain loop gives."""
    found = hostrules.judged(docs, host_limit=0.6, rule_limit=0.3).collect()
    each, by_host = [], defaultdict(lambda: [0, Counter()])
    for i, t, s in rows():
        words, _, symbols, lines, dup, repeats = measures(t)
        failed = {"base": words < 20 or 100 * repeats > 30 * words, "symbols": 10 * symbols > words, "lines": 10 * dup > 3 * lines, "repeats": 100 * repeats > 15 * words}
        each.append((i, s or "", failed))
        by_host[s or ""][0] += 1
        by_host[s or ""][1].update(k for k, v in failed.items() if v)
    rates = defaultdict(dict)
    n = sum(h[0] for h in by_host.values())
    for rule in ("base", "symbols", "lines", "repeats"):
        p = sum(h[1][rule] for h in by_host.values()) / n
        q, weight = hostrules.prior(len(by_host), n, sum(h[0] ** 2 for h in by_host.values()), p * n, sum(h[1][rule] ** 2 / h[0] for h in by_host.values()))
        assert abs(p - q) < 1e-12 and 1 <= weight <= n
        for host, (size, fails) in by_host.items():
            rates[host][rule] = (fails[rule] + weight * p) / (size + weight)
    want = Counter()
    for i, host, failed in each:
        r = rates[host]
        verdict = "base" if failed["base"] else "host" if max(r.values()) > 0.6 else next((k for k in ("symbols", "lines", "repeats") if failed[k] and r[k] > 0.3), None)
        want[i, host, verdict, verdict is None] += 1
    assert Counter((r.doc_id, r.host, r.verdict, r.kept) for r in found) == want
    assert {v for _, _, v, _ in want} >= {"base", None}
    assert hostrules.judged(empty).count() == 0


def test_hosts_are_shrunk(spark):
    """A bad host goes as a whole, clean documents too; a host of one bad document doesn't; in other hosts clean documents stay."""
    clean, bad = " ".join(f"w{i}" for i in range(50)), "too short"
    items = [(i, clean, f"h{i % 20}") for i in range(1000)] + [(2000 + i, bad, "bad") for i in range(90)] + [(3000 + i, clean, "bad") for i in range(10)]
    items += [(4000, bad, "tiny"), (4001, clean, "tiny")]
    found = {r.doc_id: r for r in hostrules.judged(spark.createDataFrame(items, "doc_id long, text string, source string")).collect()}
    assert all(found[i].kept for i in range(1000)) and not any(found[i].kept for i in range(2000, 2090))
    assert {found[i].verdict for i in range(3000, 3010)} == {"host"}
    assert found[2000].host_rate > 0.8 and found[0].host_rate < 0.05
    assert 0.05 < found[4001].host_rate < 0.5 and found[4001].kept  # one of two, shrunk towards the mean


def test_hosts_of_urls(spark):
    df = spark.createDataFrame([("https://M.Example.org/en/25#top",), ("no url",), (None,)], "u string").select(hostrules.host_of(F.col("u")).alias("h"))
    assert [r.h for r in df.collect()] == ["m.example.org", None, None]


def filters(text, first):
    words = WORD.findall(text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), first]


def test_audit(spark, docs, empty):
    """Every order applied to every row, one filter after another."""
    labels = [(0, 1, 0), (1, 0, 1), (3, 1, 1), (3, None, 0), (None, 1, 1), (1001, 1, 1), (1002, 1, None), (99999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filteraudit.audit(docs, marks).collect()
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows():
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, s in rows():
        parts[s or ""].append((filters(t or "", i is not None and first[t or ""] < i), i in good, i in toxic))
    want = {}
    for part, members in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                out = [m for m in left if m[0][k]]
                gone = [m for m in members if m[0][k] and any(m[0]["ABCDE".index(x)] for x in order[: step - 1])]
                left = [m for m in left if not m[0][k]]
                shapley[f] += len(out)
                want[part, "".join(order), step] = [len(left), len(out), len(gone), sum(m[0][k] and sum(m[0]) == 1 for m in members), sum(m[1] for m in out), sum(m[2] for m in out)]
        for key in [x for x in want if x[0] == part]:
            want[key].append(shapley[key[1][key[2] - 1]])
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found} == want
    assert len(found) == 600 * len(parts)
    assert filteraudit.audit(empty, marks).count() == 0
    assert filteraudit.audit(docs, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def grams(text, longest):
    words = re.findall(importance.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, docs, empty, longest):
    target = [(0, "abc Abc the # 漢字 tag tag"), (1, None), (1, ""), (None, "50 b b")]
    texts = spark.createDataFrame([(*x, "clash") for x in target], "item_id long, text string, doc_id string")
    found = importance.resampled(docs, texts, longest=longest).collect()
    s, t = Counter(), Counter()
    for held, items in ((s, [x for _, x, _ in rows()]), (t, [x for _, x in target])):
        for x in items:
            held.update(zlib.crc32(g.encode()) % 10000 for g in grams(x, longest)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    scored = []
    for i, x, _ in rows():
        n_words, features = grams(x, longest)
        weight = sum(gain[zlib.crc32(g.encode()) % 10000] for g in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    drawn = able[: 10 * len(able) // 100]
    assert Counter(tuple(r)[:4] for r in found) == Counter(x[:4] for x in scored)
    assert sorted((r.rank, r.doc_id, r.score) for r in found if r.rank is not None) == [(k, x[0], x[3]) for k, x in enumerate(drawn, 1)]
    assert importance.resampled(empty, texts).count() == 0
    assert importance.resampled(docs, texts.limit(0)).count() == len(scored)


def test_segments(monkeypatch):
    """Texts are cut between words only, and nothing is lost."""
    monkeypatch.setattr(importance, "SEGMENT_BYTES", 7)
    texts = ["", "ab", "abc def ghi jkl mno", "abcdefghijklmnopqrstuvwxyz0123456789 x", "#" * 30, "éé éé éé éé éé éé", "word" * 9]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = importance._segments(data, offsets).to_pylist()
    assert ["".join(r["text"] for r in found if r["row"] == i) for i in range(len(texts))] == texts
    for i, t in enumerate(texts):
        assert [w for r in found if r["row"] == i for w in re.findall(importance.WORD, r["text"])] == re.findall(importance.WORD, t)
    assert sum(r["row"] == 2 for r in found) > 1


def test_ranks(spark):
    """Ties go to the smaller id, null first, over blocks of scores and whatever their sign."""
    rng = random.Random(2)
    items = [(i if i % 50 else None, rng.randint(-3000, 3000) // 40 * 40, i % 3 > 0) for i in range(3000)]
    df = spark.createDataFrame([(*x, "clash") for x in items], "doc_id long, score long, able boolean, n string")
    found = importance.ranked(df.drop("n"), F.col("able"), 30).collect()
    able = sorted((x for x in items if x[2]), key=lambda x: (-x[1], -1 if x[0] is None else x[0]))
    assert [(r.doc_id, r.score) for r in sorted((r for r in found if r.rank is not None), key=lambda r: r.rank)] == [x[:2] for x in able[: 30 * len(able) // 100]]
    assert len(found) == 3000
