"""Each operator beside a plain version, on a small table with every awkward case, and on an empty one."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, components, decontaminate, language, line_dedup, minhash, packing, quality, sentence_dedup, substring_dedup
from tests.llm import fixtures

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def rows():
    return fixtures.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return fixtures.frame(spark, [])


def keyed(got, columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in got)


def test_decontaminate(spark, docs, rows, empty):
    words = lambda t: ITEM.findall((t or "").translate(FOLD))
    first, long = words(rows[0][1]), words(rows[-6][1])
    items = [(1, "So: " + " ".join(first[:12])), (2, " ".join(first[2:11])), (3, "one TWO"), (3, "one TWO"), (4, None), (5, "..."), (6, "unseen words here"),
             (7, " ".join(words(rows[7][1])[-25:])), (10, " ".join(first[:12])), (None, "x"), (11, " ".join(long[100:140]))]
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = collections.Counter()
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[p:p + n])].add("null" if i is None else str(i))
    for r in rows:
        w, hit, ids = words(r[1]), set(), set()
        for n in range(1, 11):
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    ids |= windows[tuple(w[p:p + n])]
        want[r[0], len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == want
    assert any(k[3] for k in want)
    assert decontaminate.decontaminate(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def test_language(docs, rows, empty):
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    text = collections.defaultdict(set)
    for r in rows:
        text[r[0]].add(r[1])
    for r in got:
        t = next(iter(text[r["carry"].doc_id])) or ""
        assert (r.lang_pred == "und") == (not any(ch.isalpha() for ch in t))
        assert 0 <= r.score <= 1 and r.lang_pred in ("und", *fixtures.LANGS)
    known = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 120 and r[2]}
    held = [r for r in got if r.held_out and r["carry"].doc_id in known]
    assert np.mean([r.lang_pred == known[r["carry"].doc_id] for r in held]) > 0.8
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_margin_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.2 * x[:, 1] > 0, 1, -1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = language.with_bias(x)
    assert np.mean(np.sign(x @ language.fit_margin(x, y)) == y) > 0.97


@pytest.mark.parametrize("keep_first,min_docs,batches", [(False, 10, 4), (True, 10, 3), (False, 2, 1), (True, 10, 8), (True, 10, 16), (False, 10, 16)])
def test_line_dedup(docs, rows, empty, keep_first, min_docs, batches):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    lines = [(r[1] or "").split("\n") for r in rows]
    seen = collections.Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    frequent = {k for k, n in seen.items() if n >= min_docs}
    got = line_dedup.dedup_lines(docs, keep_first=keep_first, min_docs=min_docs, batches=batches)
    assert set(docs.columns) | {"line_dedup"} == set(got.columns)
    got = got.select("doc_id", "line_dedup.*").collect()
    if not keep_first:
        want = collections.Counter((r[0], len(ls), sum(key(x) in frequent for x in ls), "\n".join(x for x in ls if key(x) not in frequent)) for r, ls in zip(rows, lines))
        assert keyed(got, ["doc_id", "n_lines", "n_dropped", "kept"]) == want
        assert frequent
    else:
        left = collections.defaultdict(set)
        for r in got:
            for line in r.kept.split("\n"):
                left[key(line)].add(r.doc_id)
        assert all(len(left[k]) == 1 for k in frequent)
        assert set(left) | {""} == set(seen) | {""}
    assert line_dedup.dedup_lines(empty).count() == 0
    assert "Python" not in line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()


@pytest.mark.parametrize("batches", [1, 4, 8, 16])
def test_a_shared_line_stays_in_the_first_document(spark, batches):
    table = spark.createDataFrame([(i, f"own {i}\nshared") for i in range(60)] + [(None, "none\nshared")], "doc_id long, text string")
    got = {r.doc_id: (r.batch, r.kept) for r in line_dedup.dedup_lines(table, keep_first=True, batches=batches).select(
        "doc_id", F.pmod(F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")), F.lit(batches)).alias("batch"), "line_dedup.kept").collect()}
    first = min((b, i is None, i or 0) for i, (b, _) in got.items())
    assert [i for i, (_, kept) in got.items() if "shared" in kept] == [None if first[1] else first[2]]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("larkspur_run_")]


def test_quality(spark, docs, rows, empty):
    def plain(t):
        w = SPACED.findall(t or "")
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(grams)
        again = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if SPACED.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)

    junk = [(3000 + i, " ".join(f"w{i}{j}###" for j in range(80)), "en", "", 0) for i in range(12)]
    labels = [(i, 1) for i in range(100)] + [(3000 + i, 0) for i in range(10)] + [(5, None), (None, 0), (6, 1)]
    table = docs.unionByName(fixtures.frame(spark, junk))
    got = quality.judge(table, spark.createDataFrame(labels, "doc_id long, quality int"), tree_rows=64).collect()
    want = collections.Counter((r[0], *plain(r[1])) for r in rows + junk)
    assert keyed(got, ["doc_id", *quality._STATS]) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id >= 3000)
    good = [r for r in got if r.doc_id is not None and r.doc_id < 100 and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.9
    none = quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.judge(empty, spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_chat(spark):
    rng = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "\\-", "é", "\n", "<", "x "]
    say = lambda: rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randrange(12)))])
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(40)]), rng.choice([None, "user", "assistant"]), say()) for _ in range(400)]
    rows += rows[:5]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for piece in (64, 1 << 20):
        got = {r.conv_id: r for r in chat.digests(chat.format_conversations(table, piece_bytes=piece)).collect()}
        assert set(got) == set(by)
        for conv, turns in by.items():
            turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
            loss = "".join(x[3] for x in turns if x[2] == "assistant")
            r = got[conv]
            assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
            assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, shingle, percent):
    def shingles(t):
        w = SPACED.findall((t or "").translate(FOLD))
        return {tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)].append(r[0])
    want = collections.Counter((r[0], len(sets[i]), min(low[find(i)]) if low[find(i)] else None) for i, r in enumerate(rows))
    got = minhash.near_duplicates(docs, shingle=shingle, percent=percent).collect()
    assert keyed(got, ["doc_id", "n_shingles", "component_id"]) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    stay = minhash.distinct_documents(docs, shingle=shingle, percent=percent)
    assert stay.columns == docs.columns
    assert stay.count() == len({find(i) for i in range(len(rows)) if sets[i]}) + len({(r[0], r[1]) for i, r in enumerate(rows) if not sets[i]})
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_beyond_pivots(spark):
    """A family whose members mostly do not reach the threshold with each other: the prefix join must find the rest."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        words = list(base)
        for p in rng.sample(range(150), rng.randrange(2, 14)):
            words[p] = f"n{i}x{p}"
        texts.append(words)
    for i in range(40):  # copies of copies
        words = list(texts[i])
        for p in rng.sample(range(150), 3):
            words[p] = f"m{i}x{p}"
        texts.append(words)
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)]
    sets = [{tuple(w[i:i + 3]) for i in range(148)} for w in texts]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(fixtures.frame(spark, rows), shingle=3, percent=85).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert len(set(got.values())) > 20


def test_signatures_estimate_similarity(spark):
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    for share in (0.5, 0.8, 0.95):
        n = int(1000 * 2 * share / (1 + share))
        a, b = np.sort(values[:1000]), np.sort(np.concatenate((values[:n], values[1000:2000 - n])))
        packed = [minhash._pack(minhash._minima(x, np.array([len(x)])))[0].view(np.int64).tolist() for x in (a, b)]
        est = spark.createDataFrame([tuple(packed)], "a array<long>, b array<long>").select(minhash.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(est - n / (2000 - n)) < 0.15


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)] + [(500, 500 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.v: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: find(x) for x in parent}
    assert {x: got.get(x, x) for x in want} == want


def test_sentence_dedup(docs, rows, empty):
    def split(t):
        out, cur = [], []
        ws = [m.span() for m in SPACED.finditer(t)]
        for i, (a, b) in enumerate(ws):
            cur.append((a, b))
            if re.search(r"[.!?]$", t[a:b]) or i + 1 == len(ws) or "\n" in t[b:ws[i + 1][0]]:
                out.append(cur)
                cur = []
        return out

    places = collections.defaultdict(list)
    cuts = {}
    for r in rows:
        t = r[1] or ""
        s = cuts[r[0], r[1]] = split(t)
        ok = lambda a, b: (b - a >= 2 and sum(map(len, s[a:b + 1])) >= 25) or sum(map(len, s[a:b + 1])) >= 40
        runs = {next(((a, b) for b in range(a, len(s)) if ok(a, b)), None) for a in range(len(s))}
        runs |= {next(((a, b) for a in range(b, -1, -1) if ok(a, b)), None) for b in range(len(s))}
        for a, b in runs - {None}:
            places[tuple(t[x:y].translate(FOLD) for z in s[a:b + 1] for x, y in z)].append((r[0] is None, r[0], r[1], a, b))
    gone = collections.defaultdict(set)
    for at in places.values():
        for _, i, t, a, b in [x for x in at if x[:4] != min(at)[:4]]:
            gone[i, t] |= set(range(a, b + 1))
    want = collections.Counter()
    for r in rows:
        t, s = r[1] or "", cuts[r[0], r[1]]
        edges = [z[0][0] for z in s] + [len(t)]
        kept = t[:edges[0]] + "".join(t[edges[k]:edges[k + 1]] for k in range(len(s)) if k not in gone[r[0], r[1]])
        want[r[0], len(s), len(gone[r[0], r[1]]), kept] += 1
    assert keyed(sentence_dedup.remove_passages(docs).collect(), ["doc_id", "n_sentences", "n_removed", "text"]) == want
    assert sum(map(len, gone.values())) > 50
    assert sentence_dedup.remove_passages(empty).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_substring_dedup(docs, rows, empty, block):
    """With a block of one byte every group goes the way of those that are too large for a block."""
    data = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    want = collections.Counter()
    for r, d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if count[d[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        want[r[0], len(d), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), bytes(x for x, g in zip(d, gone) if not g)] += 1
    got = substring_dedup.remove_repeats(docs, block=block).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_repeated_starts_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        length, letters = rng.choice([2, 5, 8, 20]), rng.choice([2, 3, 20])
        parts = [bytes(rng.randrange(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 12))]
        parts += [parts[0] + parts[-1][:30], b"a" * 50][:rng.randrange(3)]
        count = collections.Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if count[p[i:i + length]] > 1] for p in parts]
        assert [x.tolist() for x in substring_dedup.repeated_starts(parts, length)] == want


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = collections.Counter()
    for r in rows:
        want[r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (2,)] += 1
    got = packing.pack(docs).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, ids.tolist()))
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        total = sum(n for _, n in pieces)
        assert total == 4096 or total & (total - 1) == 0
    for (doc, ids), times in want.items():
        pieces = sorted(by_doc[doc, len(ids)])
        if times == 1 and sum(1 for d, i in want if d == doc and len(i) == len(ids)) == 1:
            assert [x for _, p in pieces for x in p] == list(ids)
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    assert packing.pack(empty).count() == 0


def test_sum_of_squares_rule():
    rng = random.Random(3)
    packer = packing.Packer(capacity=64, open_limit=20)
    sizes = [rng.randrange(1, 200) for _ in range(400)]
    for i, n in enumerate(sizes):
        if packer.open < 20:
            size = n % 64
            if size:
                levels = [h for h in range(1, 65 - size) if packer.counts[h]]
                change = {h: (2 * (packer.counts[h + size] - packer.counts[h]) + 2 if h + size < 64 else 1 - 2 * packer.counts[h]) for h in levels}
                change[0] = 2 * packer.counts[size] + 1
                best = min(change.values())
                assert packer.level(size) == max(h for h, v in change.items() if v == best)
        packer.add(i, np.full(n, i, "<u4").tobytes())
    packer.finish()
    total = collections.Counter()
    for window in packer.take():
        n = sum(len(p[2]) // 4 for p in window)
        assert n == 64 or n & (n - 1) == 0
        for row, _, ids in window:
            total[row] += len(ids) // 4
    assert total == collections.Counter(dict(enumerate(sizes)))


def test_words_outside_white_space():
    coder = packing.WordIds(None, limit=3)
    for text in ["a b Ab's  x́ ́y <|endoftext|>z <|ENDOFTEXT|> Σας ΣΑΣ q \x1c w\x85v İ 'S it'll end. é. x., 9. .", "", "  \n"]:
        for _ in range(2):
            assert np.frombuffer(coder.encode([text.encode()])[0], "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
