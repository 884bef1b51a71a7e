"""The training-data operators against brute force, round trips and held-out labels, with the cases their docstrings define."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import base, byte_cnn, chat, jaccard, labels, mixing, packing, pii, quality_rules, sketch, substrings

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, n long"


def words(text, lower=False):
    text = (text or "").encode()
    return (text.lower() if lower else text).split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns that clash with inner names."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long_text), (6, long_text + " tail"), (7, f"a b {passage} c"), (8, f"x {passage} y {passage}"), (8, f"x {passage} y {passage}"),
            (None, passage), (9, "same words here now and then " * 9), (10, "Same Words here now and then " * 9), (10, "other text under this id")]
    return spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", len(t or ""), "r", "k", 5) for i, t in rows], ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return base.table(spark, SMALL, "documents")


def empty(df):
    return df.where("false")


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    def holds(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group(0))]


def test_pii(spark, docs, odd):
    tricky = ["a@b.com_c@d.org x..y@z-1.co.uk é😀 4111 1111 1111 1111 5", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "+1 (212) 555-1234) +12 +123456789012345678 4111-1111-1111-1111", "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 XX00WEST12345698765432",
              "my ssn 123-45-6789 and 123-45-6789 far", "call (212) 555-0199 ", "@" * 300 + "a." * 300, "1" * 20_000 + "@x", "u@v.w " * 400]
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(tricky, 10_000)), "doc_id long, text string"))
    found = pii.report(both.withColumn("other", F.col("text")).withColumn("doc_id", F.monotonically_increasing_id())).collect()
    assert sorted(r.base_sha256 for r in found) == sorted(hashlib.sha256(",".join(plain_pii(r.text)).encode()).hexdigest() for r in both.collect())
    by = {t: s for t, s in zip(tricky, [r.spans for r in pii.report(spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")).orderBy("doc_id").collect()])}
    assert "iban:0:27" in by[tricky[3]] and "iban:28:50" in by[tricky[3]] and by[tricky[3]].count("iban") == 2
    assert "ssn:7:18" in by[tricky[4]] and "tel:5:19" in by[tricky[5]]
    assert pii.report(empty(odd)).count() == 0


def test_pii_redaction(spark, odd):
    texts = ["mail a@b.com, +1 (212) 555-1234.", "4111 1111 1111 1111@x.com z", "clean", None, "é" * 3000 + " u@v.w " + "ü" * 3000 + "1.2.3.4"]
    out = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "n_chars long, text string").withColumn("found", F.lit(1))).orderBy("text").collect()]
    assert sorted(out) == sorted(["mail [EMAIL], [PHONE].", "[CARD] z", "clean", "", "é" * 3000 + " [EMAIL] " + "ü" * 3000 + "[IP]"])
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()


def test_chat_round_trip(spark):
    bad = ["<|im_end|>", "<\\|x|>", "<|nl|>", "<", "a\n<|im_start|>b", "", None, "<\\\\|<|", "|im_end|>"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate([("user", b) for b in bad] + [("assistant", b) for b in bad] + [("a\nb<|im_end|>", "x"), (None, "y"), ("assistant", "tie")])]
    turns = spark.createDataFrame([*rows, (2, None, "assistant", "z"), (2, None, "assistant", "z")], "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(0))
    for parts in (1 << 20, 10):
        formatted = chat.format_chat(turns, parts)
        for ordered in (True, False):
            got = {r.conv_id: r for r in chat.read_back(formatted, ordered).collect()}
            for c in (1, None):
                mine = [(r or "", x or "") for cc, _, r, x in rows if cc == c]
                said = "".join(x for r, x in mine if r == "assistant")
                assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
                assert got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert got[2].n_turns == 2
    assert chat.read_back(chat.format_chat(empty(turns))).count() == 0
    with pytest.raises(chat.Broken):
        list(chat.parse("<|im_start|>user\nno end"))


def test_packing(docs, odd):
    from tokenizers import Tokenizer
    import public_tokenizers
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    both = docs.select("doc_id", "text").unionByName(odd.select((F.xxhash64("text", "doc_id") % 1000 + 20_000).alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    want = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [2] for r in both.collect()}
    got, places = collections.defaultdict(list), collections.defaultdict(list)
    for p in packing.pack(both).collect():
        got[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        places[p.sequence_id].append((p.offset, p.length))
        assert p.doc_tokens == len(want[p.doc_id]) and p.length == len(p.ids) // 4
    assert {d: [i for _, x in sorted(ps) for i in x] for d, ps in got.items()} == want
    for ps in places.values():
        ps.sort()
        total = sum(n for _, n in ps)
        assert [o for o, _ in ps] == [sum(n for _, n in ps[:i]) for i in range(len(ps))] and (total == 4096 or total & (total - 1) == 0) and total <= 4096 and len(ps) <= 256
    assert packing.pack(empty(odd)).count() == 0


def test_sequences_follow_training_order(spark, docs):
    """On a table of several part files, whose scan order differs from the order they were written in."""
    import corpus_pipeline
    rows = base.written(docs.crossJoin(spark.range(12)).withColumn("doc_id", F.col("doc_id") + 100_000 * F.col("id")).drop("id"))
    copies = mixing.plan(rows).select("doc_id", F.explode("positions").alias("position")).collect()
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = base.written(corpus_pipeline.mixture(spark, rows, SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(mixed.inputFiles()) > 1
    pieces = corpus_pipeline.packed(spark, mixed, SMALL).collect()
    want, got, length = collections.defaultdict(list), collections.defaultdict(list), {}
    for r in copies:
        want[r.doc_id].append(r.position)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        length[p.doc_id] = max(length.get(p.doc_id, 0), p.doc_tokens)
        got[p.doc_id].append((p.start, p.length, p.doc_tokens, p.sequence_id))
    assert set(got) == set(want)
    once = {d for d, x in want.items() if len(x) == 1}
    starts, at = {}, 0
    for position, d in sorted((x, d) for d, xs in want.items() for x in xs):
        starts.setdefault(d, at)
        at += length[d]
    assert at > 4 * packing.WINDOW and len(once) > 50
    placed = sorted((sequence, starts[d] + start) for d in once for start, n, _, sequence in got[d])
    furthest = np.maximum.accumulate([p for _, p in placed])
    assert all(p >= f - 2 * packing.WINDOW for (_, p), f in zip(placed, furthest))


def test_packing_windows():
    """Each window's tokens leave in its own sequences or in the next window's; nothing waits longer, nothing is lost."""
    rng = np.random.default_rng(5)
    sizes = [int(n) for n in rng.choice([1, 3, 40, 300, 900, 5000, 12_000], 600)]
    packer = packing.Packer(7, 4096, 256, 4095, 8 * 4096)
    for d, n in enumerate(sizes):
        packer.add(d, np.arange(n, dtype="<u4").tobytes())
    packer.pack(0, last=True)
    first, sums, seen = np.concatenate([[0], np.cumsum(sizes)]), collections.Counter(), collections.defaultdict(list)
    furthest = 0
    for d, start, n, ids, total, sequence, at in packer.rows:
        assert total == sizes[d] and at == sums[sequence] and np.array_equal(np.frombuffer(ids, "<u4"), np.arange(start, start + n))
        sums[sequence] += n
        seen[d].append((start, n))
        furthest = max(furthest, first[d] + start)
        assert first[d] + start + 2 * (8 * 4096 + 4096) >= furthest
    assert all(sum(n for _, n in x) == sizes[d] and len({s for s, _ in x}) == len(x) for d, x in seen.items()) and len(seen) == len(sizes)
    assert [r[5] for r in packer.rows] == sorted(r[5] for r in packer.rows) and min(sums) == 7 << 32
    assert all(n == 4096 or n & (n - 1) == 0 for n in sums.values()) and max(sums.values()) == 4096


def plain_dedup(rows):
    seen, out = {}, []
    windows = [(i, j, tuple(w[j:j + 20])) for i, (_, w) in enumerate(rows) for j in range(len(w) - 19)]
    for i, j, k in windows:
        seen[k] = min(seen.get(k, (rows[i][0], j)), (rows[i][0], j))
    cover = [[False] * len(w) for _, w in rows]
    for i, j, k in windows:
        if seen[k] < (rows[i][0], j):
            cover[i][j:j + 20] = [True] * 20
    for (d, w), c in zip(rows, cover):
        kept = [x for x, gone in zip(w, c) if not gone]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_substring_dedup(docs, odd):
    got = [tuple(r) for r in substrings.deduplicate(docs).collect()]
    assert sorted(got) == sorted(plain_dedup(sorted((r.doc_id, words(r.text)) for r in docs.collect())))
    unique = odd.where("doc_id is null or doc_id not in (8, 10)")
    low = -(1 << 63)
    want = plain_dedup(sorted((low if r.doc_id is None else r.doc_id, words(r.text)) for r in unique.collect()))
    assert sorted((low if r.doc_id is None else r.doc_id, *r[1:]) for r in substrings.deduplicate(unique).collect()) == sorted(want)
    repeated = {(r.doc_id, r.n_words): r.n_removed for r in substrings.deduplicate(odd).collect()}
    assert repeated[8, 52] == 50 and repeated[None, 25] == 0 and repeated[10, 5] == 0 and substrings.deduplicate(odd).count() == odd.count()
    assert substrings.deduplicate(empty(odd)).count() == 0


def plain_groups(rows, run, percent):
    sets = {}
    for d, text in rows:
        w = words(text, True)
        k = min(run, len(w))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d)) for d in sets}


def test_jaccard_join(spark, docs, monkeypatch):
    rng = np.random.default_rng(3)
    line = " ".join(f"c{i}" for i in range(20))
    base_words = [f"b{i}" for i in range(90)]
    rows = [(1000 + i, " ".join(np.where(rng.random(90) < 0.015, f"n{i}", base_words))) for i in range(60)]
    rows += [(2000 + i, line + " " + " ".join(f"u{i}_{j}" for j in range(int(rng.integers(1, 60))))) for i in range(60)]
    rows += [(3000, None), (3001, ""), (3002, "x"), (3003, "X"), (3004, "x y")]
    rows += [(r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x"))
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    assert {tuple(r) for r in jaccard.groups(df, 4, 85).collect()} == plain_groups(rows, 4, 85)


def test_jaccard_odd(spark, odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.groups(odd).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[3, 0] == 3 and got[4, 1] == 4 and got[10, 2] == 10
    assert len({v for (d, n), v in got.items() if d == 9 or (d == 10 and n > 2)}) == 1
    kept = jaccard.keep_first(odd, 5, 80)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 1 and kept.where("doc_id in (1, 2, 3, 4)").count() == 4 and kept.where("doc_id = 10").count() == 1
    assert jaccard.groups(empty(odd)).count() == 0 and jaccard.keep_first(empty(odd)).count() == 0


def test_sketch(spark, docs, odd):
    pairs = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in sketch.edited(docs).select("doc_id", "n_chars", "edited_sha256", sketch.printed("own").alias("fp"), sketch.likeness("own", "edit").alias("near"), sketch.likeness("own", "next").alias("next")).collect()}
    shingles = lambda t: {tuple(w[i:i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))}
    prints = collections.defaultdict(set)
    for i, (d, t) in enumerate(pairs):
        after = pairs[(i + 1) % len(pairs)][1]
        changed = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = shingles(t), shingles(changed), shingles(after)
        assert abs(r.near - len(a & b) / len(a | b)) < 0.3 and abs(r.next - len(a & c) / len(a | c)) < 0.2
        prints[t].add(r.fp)
    assert all(len(x) == 1 for x in prints.values()) and len({next(iter(x)) for x in prints.values()}) == len(prints)
    assert sketch.edited(odd).count() == odd.count() and sketch.edited(empty(odd)).count() == 0
    union = sketch.merge(sketch.fingerprints(docs).withColumn("g", F.lit(1)), ["g"], "sketch").first().sketch
    assert len(union.kept) > 48 and union.bound <= sketch._CUT or union.bound > 0


def test_quality_rules(spark, docs, odd):
    known = base.WordHash()
    text = "a b c a b c ## x\n\nline one\nline one\n \n|é"
    assert quality_rules.counts(text.encode(), known)[0] == [13, 25, 3, 1, 6]
    trees = quality_rules.train(docs, base.table(spark, SMALL, "labels"))
    judged = {r.doc_id: r for r in quality_rules.judge(docs, trees).collect()}
    truth = {r.doc_id: r.quality for r in base.table(spark, SMALL, "labels").collect()}
    good = [judged[d].kept for d, q in truth.items() if q == 1 and not judged[d].base_failed]
    assert sum(good) >= 0.9 * len(good)
    x = np.random.default_rng(1).random((50, len(quality_rules.FEATURES)))
    for f in (2, 3, 4):
        scores = [trees.score(np.where(np.arange(x.shape[1]) == f, v, x)) for v in np.linspace(0, 1, 30)]
        assert (np.diff(scores, axis=0) <= 1e-12).all()
    assert quality_rules.train(docs, empty(base.table(spark, SMALL, "labels"))) is None
    assert quality_rules.judge(odd, None).count() == odd.count() and quality_rules.judge(empty(odd), trees).count() == 0
    kept = quality_rules.keep(odd, None)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in quality_rules.judge(odd, None).collect())


def test_byte_network(spark, odd):
    d = "/root/testdata/sf0.01"
    docs, marks = base.table(spark, d, "documents"), base.table(spark, d, "labels")
    net = byte_cnn.train(docs, marks)
    scored = {r.doc_id: r.score for r in byte_cnn.score(docs, net).collect()}
    held = [(scored[r.doc_id], r.quality) for r in marks.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    long_text = ("word " * 30_000).encode()
    pieces = np.maximum(net.answers(np.frombuffer(long_text + bytes(4), np.uint8)).max(0) + net.bias, 0)
    assert np.allclose(net.describe(long_text)[byte_cnn.FILTERS:], pieces, atol=1e-5)
    assert all(0 <= r.score <= 1 for r in byte_cnn.score(odd, net).collect()) and byte_cnn.score(empty(odd), net).count() == 0
    assert byte_cnn.train(docs, empty(marks)).score([b"x"])[0] == 1.0


def test_mixing(spark, docs, odd):
    plan = mixing.plan(docs).collect()
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    sums, taken, target = collections.Counter(), collections.Counter(), {}
    for r in plan:
        assert r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] and list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        sums[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    total, share = sum(sums.values()), None
    weight, capped = {s: 1 + i % 3 for i, s in enumerate(sorted(sums))}, set()
    while True:
        rest = total - sum(3 * sums[s] for s in capped)
        want = {s: 3 * sums[s] if s in capped else rest * weight[s] / sum(weight[x] for x in weight if x not in capped) for s in weight}
        over = {s for s in weight if want[s] > 3 * sums[s]}
        if not over:
            break
        capped |= over
    assert all(abs(want[s] - target[s]) < 1e-6 * total and abs(taken[s] - target[s]) <= 1 for s in weight)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, plan))
    assert mixing.plan(odd).count() == odd.count() and mixing.mix(odd).columns == odd.columns and mixing.plan(empty(odd)).count() == 0 and mixing.mix(empty(odd)).count() == 0
    assert sum(len(words(r.text)) for r in mixing.mix(odd).collect()) == sum(r.taken for r in mixing.plan(odd).collect())


def test_mixing_equal_rows_of_several_sources(spark):
    """Rows equal in id and text, but of different sources, keep their own source's copies; one id's rows spread over slices."""
    texts = [" ".join(f"w{i}x{j}" for j in range(5 + i)) for i in range(20)]
    rows = [(None, t, s) for t in texts for s in ("a", "b", None)] + [(7, t, s) for t in texts for s in ("c", "a")] + [(i, "x " * 400, "d") for i in range(100, 110)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(df).collect()
    taken, mixed = collections.Counter(), collections.Counter()
    for r in plan:
        taken[r.source] += r.taken
    for r in mixing.mix(df).collect():
        mixed[r.source] += len(words(r.text))
    assert len({taken[s] for s in ("a", "b", "c", None)}) > 1 and mixed == taken
    first = {r.positions[0] for r in plan if r.doc_id is None and r.source == "b" and r.positions}
    assert len(first) > 1 and len(plan) == len(rows)


def test_inverse_demand():
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    for knots in mixing.SCHEDULES.values():
        t, w = zip(*knots)
        grid = np.linspace(0, 1, 2001)
        area = np.concatenate([[0], np.cumsum((np.interp(grid[1:], t, w) + np.interp(grid[:-1], t, w)) / 2)])
        for r in spark.range(21).select((F.col("id") / 20).alias("s")).select("s", mixing.position(F.col("s"), knots).alias("at")).collect():
            assert abs(np.interp(r.at, grid, area / area[-1]) - r.s) < 1e-3


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline
    df = base.table(spark, SMALL, "documents")
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = base.written(stage(spark, df, SMALL))
        assert df.columns == columns and df.count() > 0, name
    assert not df.where(F.col("text").rlike(PATTERNS["email"])).count()
    left = {w[i:i + 5] for r in df.collect() for w in [tuple(words(r.text, True))] for i in range(len(w) - 4)}
    assert left and corpus_pipeline.STAGES[-1][1](spark, df, SMALL).count() > 0
    assert labels.held_out is not None
