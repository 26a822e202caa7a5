"""Fill-in-middle, best-fit packing and vector codes against plain versions of the same rules."""

import collections
import hashlib
import math
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from plumbline.llm import best_fit_packing, fill_in_middle, queries, vector_codes  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, form string, frames string, id long, first string, length long"


def rows():
    texts = [None, "", "a", "é", "🎉🎊", "ab<P>cd", "x<S>", "<M", "<<S", "plain words of a text " * 40, "Ünïcödé 漢字 🎉 " * 500, "\n\n", "<P" + ">"]
    out = [(i, t, 5, "f", "g", 3, "h", 9) for i, t in enumerate(texts)]
    out += [(100 + i, "".join(chr(97 + (i * j) % 26) for j in range(i * 7)), 5, "f", "g", 3, "h", 9) for i in range(60)]
    return [*out, out[9], (None, "no id at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def filled(doc_id, text):
    """Output row of one text by the rule itself."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.mark.parametrize("frame_bytes", [5, 64, fill_in_middle.FRAME_BYTES])
def test_fill_in_middle(spark, odd, none, frame_bytes):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60" if frame_bytes < 64 else "true")):
        got = fill_in_middle.unpacked(fill_in_middle.infill(fill_in_middle.store(df, frame_bytes=frame_bytes))).collect()
        pairs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = [(*filled(d, t), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in pairs]
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text, r.restored_sha256)) for r in got)
        assert all(r.output_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got)
    assert fill_in_middle.infill(fill_in_middle.store(none)).count() == 0


def test_fill_in_middle_reuses_whole_frames():
    data = np.frombuffer(("abcdefg " * 5000).encode(), np.uint8)
    frames, before, n = fill_in_middle.cut_frames(data, 1000)
    text = fill_in_middle.Seekable(frames, before, n)
    out = fill_in_middle.arranged(text, "psm", 2500, 30100, [b"<P>", b"<S>", b"<M>"])
    assert len(frames) == 40 and len(set(frames[:2] + frames[3:30] + frames[31:]) - set(out)) == 0
    assert b"".join(map(fill_in_middle.plain, out)) == b"<P>" + data[:2500].tobytes() + b"<S>" + data[30100:].tobytes() + b"<M>" + data[2500:30100].tobytes()


def lloyd(rows, rounds=4):
    """Codes and final codebooks of (id, vector) rows by full scans in whole numbers."""
    kept = sorted(((i is None, i or 0), [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = -(-max(len(v) for _, v in kept) // 4) * 4
    x = np.array([v + [0] * (width - len(v)) for _, v in kept], object).reshape(len(kept), 4, -1)
    books = [x[:256, p] for p in range(4)]
    for k in range(rounds + 1):
        codes = np.array([[min(range(len(books[p])), key=lambda e: (((v[p] - books[p][e]) ** 2).sum(), e)) for p in range(4)] for v in x])
        if k < rounds:
            books = [np.array([x[codes[:, p] == e, p].sum(0) // (codes[:, p] == e).sum() if (codes[:, p] == e).any() else c for e, c in enumerate(books[p])])
                     for p in range(4)]
    errors = [sum(((v[p] - books[p][c[p]]) ** 2).sum() for p in range(4)) for v, c in zip(x, codes)]
    return sorted((key, bytes(c.tolist()).hex(), int(e)) for (key, _), c, e in zip(kept, codes, errors)), books


def vectors(n, seed, size=8, spread=0.3):
    rng = np.random.default_rng(seed)
    made = [(i, (rng.normal(size=size) * spread + rng.integers(0, 3, size)).astype(np.float32).tolist(), int(i % 5) if i % 7 else None) for i in range(n)]
    return made + made[:3]


@pytest.mark.parametrize("case", ["plain", "odd", "far"])
def test_vector_codes(spark, case):
    made = vectors(600, 4)
    if case == "odd":
        nan, inf = float("nan"), float("inf")
        made = vectors(90, 5) + [(200, None, 1), (201, [1.0, None, 2.0], 1), (202, [nan] * 8, 1), (203, [inf, 1.0], None), (None, [0.5] * 8, None), (None, [0.5] * 8, None),
                                 (204, [], 2), (205, [0.25] * 5, 3), (3, [0.1] * 8, 2)]
    if case == "far":  # squares beyond the whole numbers of floating point
        made = [(i, [x * 20_000 for x in v], b) for i, v, b in vectors(300, 6, 4)]
    df = spark.createDataFrame([(i, v, b, "x", 1) for i, v, b in made], "vec_id long, embedding array<float>, label int, code string, x int").repartition(5)
    coded, books = vector_codes.learn(df)
    got = coded.collect()
    want, want_books = lloyd([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in made])
    assert sorted(((r.id is None, r.id or 0), r.code, r.error) for r in got) == want
    assert books.tolist() == [[list(map(int, c)) for c in b] for b in want_books]
    if case == "plain":
        assert sum(r.scans for r in got) < 0.7 * 5 * 4 * 256 * len(got)
    total = collections.defaultdict(int)
    for r in got:
        total[r.label] += r.error
    out = vector_codes.label_errors(coded).collect()
    assert len(out) == len(got) and all(r.label_error == total[r.label] for r in out)
    back = vector_codes.restored(coded.limit(3), books).collect()
    assert all(np.allclose(r.vector, np.concatenate([books[p][e] for p, e in enumerate(bytes.fromhex(r.code))]) / 1024) for r in back)


def test_vector_codes_many_labels(spark, monkeypatch):
    """Labels below the share of heavy ones are exchanged; results do not change."""
    monkeypatch.setattr(vector_codes, "HEAVY", 3)
    coded = spark.createDataFrame([(i, None if i % 3 == 0 else i % 40, "00", i, 0) for i in range(500)], "id long, label int, code string, error long, scans long")
    want = {r.label: r.s for r in coded.groupBy("label").agg(F.sum("error").alias("s")).collect()}
    out = vector_codes.label_errors(coded).collect()
    assert len(out) == 500 and all(r.label_error == want[r.label] for r in out)


def test_vector_codes_none(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.learn(df)
    assert coded.count() == 0 and vector_codes.label_errors(coded).count() == 0 and vector_codes.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()


def laid_out(plan, counts, tokens):
    """Every rank of every length lies in one run, and every sequence is filled from 0 without gaps or overlap."""
    ranks, spans = collections.defaultdict(list), collections.defaultdict(list)
    for r in plan.runs:
        ranks[r.length].append((r.first, r.first + r.count))
        for k in range(r.count):
            spans[r.sequence + k // r.per].append((r.offset + k % r.per * r.length, r.length))
    for length, parts in ranks.items():
        parts.sort()
        assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == counts[length]
    assert set(ranks) == set(np.flatnonzero(counts)) and sorted(spans) == list(range(plan.sequences))
    for parts in spans.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= tokens


def fewest(items, room):
    """The least number of sequences, by trying all."""
    best = len(items)

    def go(k, left):
        nonlocal best
        if len(left) >= best:
            return
        if k == len(items):
            best = len(left)
            return
        for i in {x: i for i, x in enumerate(left) if x >= items[k]}.values():
            go(k + 1, [x - items[k] * (j == i) for j, x in enumerate(left)])
        go(k + 1, [*left, room - items[k]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def test_best_fit_plan():
    rng = np.random.default_rng(7)
    for k in range(150):
        tokens = int(rng.choice([8, 16, 33]))
        items = rng.integers(1, tokens + 1, int(rng.integers(0, 12)))
        counts = np.bincount(items, minlength=tokens + 1)
        laid_out(best_fit_packing.Plan(counts, tokens, groups=int(rng.choice([1, 3, 8]))), counts, tokens)
        plan = best_fit_packing.Plan(counts, tokens)  # each length is a group of its own
        laid_out(plan, counts, tokens)
        assert plan.sequences <= fewest(items.tolist(), tokens) + 1
    for items, most in ((rng.integers(300, 900, 3000), 1.03), (np.minimum(2048, rng.lognormal(5.7, 1.2, 3000).astype(int) + 1), 1.01), (np.full(3000, 600), 1.14)):
        counts = np.bincount(items, minlength=2049)
        plan = best_fit_packing.Plan(counts)
        laid_out(plan, counts, 2048)
        assert plan.sequences <= most * items.sum() / 2048 + 1
    pairs = rng.integers(300, 1700, 4000)  # there is a packing without any room left
    counts = np.bincount(np.concatenate([pairs, 2048 - pairs]), minlength=2049)
    assert best_fit_packing.Plan(counts).sequences <= 1.04 * 4000


def test_knapsack():
    rng = np.random.default_rng(8)
    for _ in range(100):
        sizes, values, room = np.unique(rng.integers(3, 20, 5)), rng.random(5), int(rng.integers(3, 60))
        values = values[:len(sizes)]
        best = [0.0] * (room + 1)
        for c in range(room + 1):
            best[c] = max([best[c - s] + v for s, v in zip(sizes, values) if s <= c], default=0.0)
        taken = best_fit_packing.knapsack(sizes, values, room)
        assert taken @ sizes <= room and abs(taken @ values - best[room]) < 1e-9


def test_best_fit_packing(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd.where("doc_id is not null").dropDuplicates(["doc_id"]), odd):
        out = best_fit_packing.pack(df, queries.tokenizer_path()).collect()
        spans, found = collections.defaultdict(list), collections.defaultdict(list)
        for p in out:
            spans[p.sequence_id].append((p.offset, p.length))
            found[p.doc_id].append((p.piece, p.start, p.length, p.ids))
            assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        for parts in spans.values():
            parts.sort()
            assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 2048
        want = collections.defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
            want[r.doc_id] += [(k, a, len(ids[a:a + 2048]), ids[a:a + 2048]) for k, a in enumerate(range(0, len(ids), 2048))]
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
        assert len(spans) <= 1.02 * sum(p.length for p in out) / 2048 + 1
    assert best_fit_packing.pack(none, queries.tokenizer_path()).count() == 0
