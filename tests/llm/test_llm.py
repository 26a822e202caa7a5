"""The text operators against brute force, SQL, exact round trips and odd inputs."""

import collections
import itertools
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import corpus_pipeline  # noqa: E402
from compare import canon  # noqa: E402
from plumbline.llm import (context_tree, decontamination, jaccard_join, language_id, license_scan, line_dedup, packing, quality_classifier,  # noqa: E402
                           quality_rules, queries, sharding)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _th long, id string, key long"
PASSAGE = " ".join(f"word{i}" for i in range(40))
LINES = "first line of it\nsecond line here\nthird line now\nfourth one"


def rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    texts = [None, "", "  \n ", "one", PASSAGE, PASSAGE, PASSAGE + " tail", LINES, "other\n" + LINES + "\nend", long, "don't <|endoftext|> 12,34 é…,b", "a\x0bb\x0cc",
             "Äpfel und Öl " * 30, "a b c d e f g h i j a b c d e f g h k l m n o p q r s t"]
    out = [(i, t, "en" if i % 2 else None, "s", 1, 0.5, 7, "x", 3) for i, t in enumerate(texts)]
    return [*out, (4, PASSAGE, "en", "s", 1, 0.5, 7, "x", 3), (None, PASSAGE, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toArrow().to_pandas()
    want = con.sql(queries.SQL[name]).to_arrow_table().to_pandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_quality_rules_odd(odd, none):
    got = {(r.doc_id): r for r in quality_rules.ledger(odd).collect()}
    assert got[0].n_words == got[1].n_words == got[2].n_words == 0 and got[9].n_words == 30_000
    assert got[13].n_repeat_words == 16 and got[11].n_words == 3
    assert quality_rules.ledger(none).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns
    table = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(odd), "v1").collect()}
    bits = [r.failed_rules for r in quality_rules.ledger(odd).collect()]
    assert table["too_few_words"].failed == sum(b & 1 for b in bits)
    assert table["too_few_words"].kept_without == sum(b & ~1 == 0 for b in bits)


def test_line_dedup_odd(odd, none):
    out = line_dedup.remove_repeats(odd)
    assert out.columns == [*odd.columns, "n_removed"] and out.count() == odd.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[8].text == "other\nend" and got[8].n_removed == 4 and got[7].text == LINES and got[0].text is None
    assert line_dedup.remove_repeats(none).count() == 0


def test_sharding(docs, odd, none):
    sized = docs.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("group"))
    got = sharding.shard(sized, 5, rows_per_range=30).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [sum(r["size"] for r in x) for x in by.values()]
    assert len(got) == 200 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert sharding.shard(none.select("doc_id", F.lit(1).alias("size"), F.lit(1).alias("group"), F.lit(0).alias("slot")), 4).count() == 0
    one = sharding.shard(odd.select("doc_id", F.lit(None).cast("long").alias("size"), "text").withColumnRenamed("text", "group"), 4)
    assert one.count() == odd.count()


def test_packing_round_trip(docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        pieces = packing.pack(df, queries.tokenizer_path()).collect()
        of, seq = collections.defaultdict(dict), collections.defaultdict(list)
        for p in pieces:
            of[p.doc_id][p.start] = p.ids
            seq[p.sequence_id].append((p.offset, p.length))
            assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and p.length == len(p.ids)
        for r in df.select("doc_id", "text").collect():
            ids = [i for s in sorted(of[r.doc_id]) for i in of[r.doc_id][s]]
            assert ids == t.encode(r.text or "", add_special_tokens=False).ids + [1]
        for parts in seq.values():
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
            used = parts[-1][0] + parts[-1][1]
            assert used <= 2048 and len(parts) <= 64
    assert packing.pack(none, queries.tokenizer_path()).count() == 0
    tight = packing.pack(docs.withColumn("lead", F.lit(10)), queries.tokenizer_path(), prompt="lead", segments=2, loss=1000)
    worst = tight.withColumn("borne", F.col("length") - F.least("length", F.greatest(F.lit(0), 10 - F.col("start")))).groupBy("sequence_id").agg(
        F.count("*").alias("n"), F.sum("borne").alias("b"), F.sum("length").alias("t")).agg(F.max("n"), F.max("b"), F.max("t")).first()
    assert worst[0] <= 2 and worst[1] <= 1000 and worst[2] <= 2048


def padding(pieces):
    """(tokens held, tokens of padding up to 2048) over sequences, those of a power of two unpadded."""
    used = [r[1] for r in pieces.groupBy("sequence_id").sum("length").collect()]
    return sum(used), sum(2048 - n for n in used if n & (n - 1))


def test_packing_of_short_texts_needs_no_padding(spark):
    """The piece limit or the loss limit closes nearly all of these sequences early."""
    short = spark.range(6400).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text")).coalesce(1)
    for kw in ({}, {"segments": 3}, {"loss": 100}, {"segments": 7, "loss": 33}):
        pieces = packing.pack(short, queries.tokenizer_path(), **kw)
        held, pad = padding(pieces)
        assert held == pieces.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0] and pad == 0
        n, free = pieces.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t")).agg(F.max("n"), F.max("t")).first()
        assert n <= kw.get("segments", 64) and free <= 2048


def test_language_sample_reads_every_part_of_texts(spark):
    """Training slices lie anywhere in a text, and a language is learnt although all its rows share one id or are equal."""
    rows = [(1, "aa", f"alpha{'x' * (i % 7)} beta gamma") for i in range(3000)] + [(2, "bb", "gost bunu")] * 3000
    rows += [(10 + i, "cc", "first " * 400 + "last " * 400) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language_id.sample(docs, train_docs=40, train_bytes=8000)
    assert set(got) == {"aa", "bb", "cc"} and "gost bunu" in got["bb"]
    assert "first" in got["cc"] and "last" in got["cc"] and all(len(x.encode()) <= 8000 for x in got.values())
    assert got == language_id.sample(docs.repartition(5), train_docs=40, train_bytes=8000)


def test_decontamination(spark, odd, none):
    swapped = PASSAGE.replace("word9 ", "WORD9 ").replace("word20 ", "zzz ")
    bench = spark.createDataFrame([(1, "lead in " + swapped), (2, None), (3, ""), (4, "don't <|endoftext|> 12,34"), (5, "lead in " + swapped)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(odd, bench).collect()}
    assert got == {(d, i) for d in (None, 4, 5, 6) for i in (1, 5)} | {(10, 4)}
    left = decontamination.drop_leaks(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 7, 8, 9, 11, 12, 13]
    assert decontamination.overlaps(none, bench).count() == 0 and decontamination.overlaps(odd, bench.limit(0)).count() == 0


def test_decontamination_masks():
    """Whichever one, two or three of twelve words are replaced, a mask inside the window lies on equal words only."""
    places = [{at + j for j, bit in enumerate(m) if bit == "1"} for m in decontamination.MASKS for at in range(decontamination.SPAN - len(m) + 1)]
    for n in range(decontamination.SPAN - decontamination.ENOUGH + 1):
        for gone in itertools.combinations(range(decontamination.SPAN), n):
            assert any(p.isdisjoint(gone) for p in places), gone


def brute_overlaps(docs, items):
    """Pairs with a window of twelve words at the same distance of which nine are equal; shorter items as a whole."""
    found = set()
    for d, text in docs:
        w = np.array(WORD.findall((text or "").translate(LOW)), object)
        for i, passage in items:
            x = np.array(WORD.findall((passage or "").translate(LOW)), object)
            span, need = min(12, len(x)), 9 if len(x) >= 12 else len(x)
            for at in range(span - len(x), len(w) - span + 1) if len(x) else ():
                low, high = max(0, -at), min(len(x), len(w) - at)
                same = (w[low + at:high + at] == x[low:high]).astype(int)
                if np.convolve(same, np.ones(span, int), "valid").max() >= need:
                    found.add((d, i))
                    break
    return found


def test_decontamination_replaced_words(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rng, made = np.random.default_rng(11), [tuple(r) for r in docs.select("doc_id", "text").collect()][:60]
    for k, (_, passage) in enumerate(items):
        for n, rate in enumerate((None, 0.2, 0.25, 0.3)):
            w = passage.split()
            for at in range(k % 4, len(w), 4) if rate is None else np.flatnonzero(rng.random(len(w)) < rate):
                w[at] = f"new{at}"
            low = int(rng.integers(max(1, len(w) - 20)))
            made.append((10_000 + 10 * k + n, " ".join(w if rate is None else ["before", *w[low:low + 20], "after"])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.overlaps(spark.createDataFrame(made, "doc_id long, text string").repartition(4), bench).collect()
    want = brute_overlaps(made, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and {10_000 + 10 * k for k in range(len(items))} <= {d for d, _ in want}


def brute_components(pairs):
    sets, parent = {}, {}
    for d, x in pairs:
        w = WORD.findall((x or "").translate(LOW))
        sets[d] = frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard_join(spark, docs, odd, none):
    base = [f"t{i}" for i in range(60)]
    rng = np.random.default_rng(5)
    near = []
    for k in range(40):  # a crowded group of near copies, some of which link only through others
        w = list(base)
        for at in rng.choice(60, k % 4, replace=False):
            w[at] = f"u{k}_{at}"
        near.append((1000 + k, " ".join(w)))
    made = spark.createDataFrame(near + [(2000 + i, " ".join(f"x{j}" for j in range(i % 9))) for i in range(30)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), made, odd.where("doc_id is not null").select("doc_id", "text").distinct()):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(df).collect()}
        assert got == brute_components([tuple(r) for r in df.collect()])
    assert jaccard_join.components(none).count() == 0
    kept = jaccard_join.keep_one(odd.where("doc_id is not null"))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 9, 10, 11, 12, 13]  # 8 shares 9 of 11 shingles with 7


def test_jaccard_join_shared_passages(spark, monkeypatch):
    """Long passages that half of the rows share, next to own words: found by rare shingles, or by turns in crowded segments."""
    monkeypatch.setattr(jaccard_join, "RARE", 16)
    rng = np.random.default_rng(3)
    made = []
    for i in range(240):
        group = int(rng.integers(60))
        w = [f"p{i % 2}_{j}" for j in range(80)] + [f"g{group}_{j}" for j in range(int(rng.choice([4, 8, 12, 20, 40])))]
        for at in rng.choice(len(w), int(rng.integers(3)), replace=False):
            w[at] = f"z{i}_{at}"
        made.append((i, " ".join(w)))
    got = jaccard_join.components(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(made)


def test_language_id(spark, docs, odd, none):
    train = docs.where("doc_id % 3 <> 1")
    got = language_id.identify(docs, train).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 1")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    out = {r.doc_id: r for r in language_id.identify(odd, train).collect()}
    assert out[0].lang_pred == out[1].lang_pred == out[2].lang_pred == "und" and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.letters("½ ²³ ① 12_3 ・") == "" and language_id.letters("Ab½c  Éd²") == "ab c éd" and language_id.letters("x1y_z") == "x y z"
    unread = odd.sparkSession.createDataFrame([(1, "½ ²³ ①", "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(unread, train).collect()] == [("und", 0.0)]
    m = language_id.Automata({"a": "abcabd", "b": "xyz"})  # parsed by hand: abc|abd|x|y|z and a|b|c|a|b|d|xyz
    text = np.frombuffer(b"abcabdxyz", np.uint8)
    assert m.phrases(text, np.array([0]), np.array([9])).ravel().tolist() == [4, 7]


def test_context_tree(docs, odd, none):
    train = F.col("doc_id") % 5 != 1
    got = {r.doc_id: r for r in context_tree.score(docs, train).collect()}
    texts = {r.doc_id: (r.text or "").translate(LOW) for r in docs.collect()}
    tokens = {d: [*WORD.findall(x), 0] for d, x in texts.items()}
    count = collections.Counter(w for d in tokens if d % 5 != 1 for w in tokens[d])
    n, v = sum(count.values()), len(count)
    for d, ws in tokens.items():
        assert got[d].n_tokens == len(ws) and got[d].n_known == sum(count[w] > 0 for w in ws) and got[d].train_tokens == n
        assert abs(got[d].base_score - sum(np.log10((count[w] + .5) / (n + .5 * (v + 1))) for w in ws)) < 1e-6 * abs(got[d].base_score)
    few = docs.where("doc_id < 6").selectExpr("doc_id", "substring(text, 1, 150) as text")
    fast = {r.doc_id: r.score for r in context_tree.score(few, train).collect()}
    for d, s in brute_ctw({r.doc_id: (r.text or "").translate(LOW).encode() for r in few.collect()}).items():
        assert abs(fast[d] - s) < 1e-3
    assert context_tree.score(none, train).count() == 0 and context_tree.score(odd, F.lit(True)).count() == odd.count()


def brute_ctw(texts):
    """Counts in nested dicts, weights by recursion over the definition."""
    from math import exp, lgamma, log, log10

    depth, tree = context_tree.DEPTH, collections.defaultdict(lambda: [0, 0])

    def steps(x):
        data = b"\xff" * depth + x + b"\xff"
        for i in range(depth, len(data)):
            context = data[i - depth:i][::-1]
            for j in range(8):
                yield context, (1 << j) | (data[i] >> (8 - j)), data[i] >> (7 - j) & 1

    for d, x in texts.items():
        if d % 5 != 1:
            for c, node, bit in steps(x):
                for k in range(depth + 1):
                    tree[c[:k], node][bit] += 1
    below = collections.defaultdict(set)
    for c, node in tree:
        if c:
            below[c[:-1], node].add((c, node))
    own = lambda n: lgamma(n[0] + .5) + lgamma(n[1] + .5) - lgamma(sum(n) + 1) - log(np.pi)
    weighted = {}
    for at in sorted(tree, key=lambda a: -len(a[0])):
        e = own(tree[at])
        weighted[at] = e if len(at[0]) == depth else float(np.logaddexp(e, sum(weighted[b] for b in below[at]))) - log(2)

    def one(c, node, k):
        at = c[:k], node
        if k > depth or at not in tree:
            return .5
        w = 1 if k == depth else exp(own(tree[at]) - log(2) - weighted[at])
        n = tree[at]
        return w * (n[1] + .5) / (sum(n) + 1) + (1 - w) * (one(c, node, k + 1) if w < 1 else 0)

    return {d: sum(log10(p if bit else 1 - p) for c, node, bit in steps(x) for p in [one(c, node, 0)]) for d, x in texts.items()}


def test_quality_classifier(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.learn(docs, labels, F.col("doc_id") % 5 != 0)
    got = quality_classifier.score(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0")
    assert got.where("(score >= 0.3) = (quality = 1)").count() >= 0.85 * got.count()
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(odd, model).collect())
    empty = quality_classifier.learn(none, labels.limit(0), F.lit(True))
    assert quality_classifier.score(none, empty).count() == 0


def test_license_scan(spark, odd, none):
    data = [(1, "x y\nReleased under the MIT License.\nmore", "a/b/f.txt"), (2, "Licensed under CC BY-NC 4.0.", "a/LICENSE"), (3, "no notice", "a/b/c/g.txt"), (4, None, "z/h.txt"),
            (5, "code", None), (6, "released and licensed", "a/k.txt"), (3, "no notice", "a/b/c/g.txt")]
    df = spark.createDataFrame(data, "doc_id long, text string, path string")
    got = [(r.doc_id, r.license, r.inherited, r.inherited_from) for r in license_scan.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT", None, None), (2, "CC-BY-NC-4.0", None, None), (3, None, "CC-BY-NC-4.0", "a"), (3, None, "CC-BY-NC-4.0", "a"),
                                           (4, None, None, None), (5, None, None, None), (6, None, "CC-BY-NC-4.0", "a")], key=str)
    assert license_scan.scan(none.withColumn("path", F.lit("x"))).count() == 0 and license_scan.scan(odd.withColumn("path", F.lit("d/x"))).count() == odd.count()


def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    kept, at = docs, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, kept, SF)
        assert at.columns == docs.columns
        kept = spark.createDataFrame(at.toArrow().to_pandas(), docs.schema)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
