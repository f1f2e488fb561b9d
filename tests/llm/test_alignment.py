"""Tokenizer alignment beside a plain version that compares byte ranges token by token."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larkspur.llm import alignment
from tests.llm import fixtures

EXTRA = ["<|endoftext|> and <s>x</s> <unk> <0x41>", "tab\there▁mark", "line\r\nbreak  two   spaces    four", "漢字 and emoji 😀 mixed", " nbsp 　 wide", "a\u0000b",
         "é ligature ﬁ ① ½", " lead", "trail ", "don't we'll I'VE", "x" * 3000, " " * 700 + "y", "😀" * 50]


@pytest.fixture(scope="module")
def rows():
    return fixtures.documents() + [(4000 + i, t, "en", "s0", 0) for i, t in enumerate(EXTRA)]


def byte_value():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + more)] = b
            more += 1
    return out


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text, and the counts of pairs."""
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value, found, counts = byte_value(), [], collections.Counter()
    for t in texts:
        a = [(i, len(one.id_to_token(i)), bytes(value[ch] for ch in one.id_to_token(i))) for i in one.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = []
        for i in two.encode(t) if t else []:
            p = two.id_to_piece(i)
            b.append((i, 0, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + t).encode() if t else b""
        if not t or b"".join(x[2] for x in a) != want or b"".join(x[2] for x in b) != want:
            found.append(None)
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, _, data in side:
                own.append((i, at, at + len(data)))
                at += len(data)
            spans.append(own)
        links = collections.Counter()
        k = 0
        for i, lo, hi in spans[0]:
            while spans[1][k][2] <= lo:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < hi:
                links[i, spans[1][m][0]] += 1
                m += 1
        shared = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        groups, before = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for i, lo, hi in side if before < hi <= end) for side in spans))
            before = end
        counts.update(links)
        found.append((len(a), len(b), len(shared), links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = f[3]
        out.append((*f[:3], sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[1]]), sum(n * counts[p] for p, n in links.items()), f[4]))
    return out, counts


@pytest.mark.parametrize("settings", [{}, {"share": 50, "piece": 300, "block": 400, "partial": 40}, {"share": 0, "piece": 2000}])
def test_equals_the_plain_version(spark, rows, settings):
    short = [r for r in rows if len(r[1] or "") < 20_000]
    got, pairs = alignment.align(fixtures.frame(spark, short), keep_groups=True, **settings)
    want, counts = plain([r[1] for r in short])
    have = collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r["groups"]) for r in got.collect())
    assert have == collections.Counter((r[0], *w) for r, w in zip(short, want))
    assert sum(w[0] == 0 for w in want) >= 3 and any(w[3] > w[4] for w in want)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(counts)
    assert all(r.groups_sha256 == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got.collect())


def test_long_texts_in_pieces(spark, rows):
    long = [r for r in rows if len(r[1] or "") >= 20_000]
    assert long and all(len(alignment.pieces(r[1], 500)) > 50 for r in long)
    whole, cut = (alignment.align(fixtures.frame(spark, long), piece=size)[0].toPandas().sort_values("doc_id").values.tolist() for size in (1 << 30, 500))
    assert whole == cut
    assert "".join(" " + p for p in alignment.pieces(long[0][1], 500)) == " " + long[0][1]


def test_empty_table_and_texts(spark):
    got, pairs = alignment.align(fixtures.frame(spark, []))
    assert got.count() == 0 and pairs.count() == 0
    got, pairs = alignment.align(fixtures.frame(spark, [(1, None, None, None, None), (2, "", "en", "", 0), (None, "a▁b", "en", "", 0)]))
    assert [tuple(r)[1:] for r in got.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3 and pairs.count() == 0
