"""The text operators against brute force, the tokenizer libraries and hand-made edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cargoscope.llm import aliases, chat, cover, graph, lines, minhash, packing, phrases, pieces, toxic

DOCS = "doc_id long, text string, lang string, node string, key string"  # the last two clash with inner names
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def edge_docs(spark):
    """Nulls, empty and blank texts, a repeated row, a very long text."""
    rows = [(1, None, None, None, None), (2, "", "en", "x", "y"), (3, " \n\t ", "en", "x", "y"), (None, "a b c d e f", "en", "x", "y"),
            (5, "a b c d e f", "en", "x", "y"), (5, "a b c d e f", "en", "x", "y"), (7, "word " * 30000, "en", "x", "y")]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed=3, n=160):
    """Random texts with exact copies, near copies of one original, and a passage in many texts."""
    r = random.Random(seed)
    draw = lambda k: [r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(k)]
    base, passage, out = draw(120), draw(40), []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 10**6))
        elif kind == 1:
            w = draw(60) + passage + draw(20)
        elif kind == 2 and out:
            w = r.choice(out).split()
        else:
            w = draw(r.randint(1, 40))
        out.append(" ".join(w))
    return out


def brute_components(texts):
    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingle(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts)
    kept = minhash.keep_one(docs(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.doc_id for r in kept.collect()} == {i for i, x in brute_components(texts).items() if x[2]}


def test_near_duplicates_edges(spark):
    got = sorted(map(tuple, minhash.near_duplicates(edge_docs(spark)).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 1, 7, True)], key=str)
    assert minhash.near_duplicates(edge_docs(spark).limit(0)).count() == 0


def test_block_links_span_all_links():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 2**63, 4).astype(np.uint64)])) for _ in range(40)]
    m = len(sets)
    forest = minhash.block_links(list(range(m)), sets, np.full(m, 2), np.zeros(m, bool), True)
    want = [(i, j) for i, j in itertools.combinations(range(m), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert want and set(forest) <= set(want) and len(forest) < m
    parts = {frozenset(x) for x in _closure(m, forest)}
    assert parts == {frozenset(x) for x in _closure(m, want)}


def _closure(m, links):
    groups = [{i} for i in range(m)]
    for a, b in links:
        x, y = next(g for g in groups if a in g), next(g for g in groups if b in g)
        if x is not y:
            groups.remove(y)
            x |= y
    return groups


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (7, None), (50, 60), (60, 50), (60, 70)] + [(200, 200 + i) for i in range(1, 30)]
    r.shuffle(links)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {50: 50, 60: 50, 70: 50} | {200 + i: 200 for i in range(30)}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, k=5):
    v = {i: np.floor(256 * np.array(e, np.float32).astype(np.float64)).astype(np.int64) for i, e in rows
         if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = {}
    for q in (i for i in v if i % 50 == 0):
        s = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q]))
        out.update({(q, n + 1): (i, -score) for n, (score, i) in enumerate(s[:k])})
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover, "ROWS", 40)
    monkeypatch.setattr(cover, "QUERIES", 4)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((4, 6)) * 3
    rows = [(i, (centre[i % 4] + rng.standard_normal(6) * 0.2).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(120)] + [(900, None), (950, [1.0, None] + [0.0] * 4), (1000, [float("nan")] * 6), (None, [9.0] * 6), (1050, [1.0, 2.0]), (1051, [2.0, 1.0])]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS q", "2 AS leaf")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in cover.top_k(df).collect()}
    assert got == brute_top(rows)
    assert cover.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("big", [5e6, 1e30])
def test_top_k_of_large_components(spark, monkeypatch, big):
    """Exact whole numbers beyond the doubles: nothing is left out and ranks stay right."""
    monkeypatch.setattr(cover, "ROWS", 20)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(3) * (big if i % 3 else 1.0)]) for i in range(150)] + [(150, [1.0, 0.0, 0.0]), (151, [big, 0.0, 0.0]), (152, [2.0, 0.0, 0.0])]
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    want = {}
    for q in (0, 50, 100, 150):
        found = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q)[:5]
        want.update({(q, n + 1): (i, -s if -2**63 <= -s < 2**63 else None) for n, (s, i) in enumerate(found)})
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cover.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.standard_normal((200, 4)) * 0.1 + c for c in np.eye(4) * 20])
    tree = cover.Tree(points)
    at, far = tree.place(points)
    radius = {int(i): float(far[at == i].max()) for i in np.unique(at)}
    covering = tree.radii(radius)
    assert all(np.linalg.norm(points[i] - tree.centres[0]) <= covering[0] + 1e-9 for i in range(len(points)))
    pairs = set(tree.pairs(radius, radius, {i: 300.0 for i in radius}))
    scores = points @ points.T
    for a, b in zip(*np.nonzero(scores >= 300)):
        assert (at[a], at[b]) in pairs
    assert len(pairs) < len(radius) ** 2 / 2


PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n=800):
    r = random.Random(9)
    bits = ["a", "the", " ", " ", "  ", "\n", "é", "日本", "ing", "▁", "😀", "0", "\t", ".", "'s", "\x1c", "\xa0", "　", "<s>", "<|endoftext|>", "Ġ", "\x00"]
    return ["", " ", "   ", "  lead", "trail  ", "x" * 500 + " y", "ab" * 5000] + ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(n)]


def test_pieces_equal_library():
    c = pieces.Coder(PIECES)
    lib, texts = c.vocabulary.library, odd_texts()
    for t, (ids, decoded) in zip(texts, c.texts(texts)):
        want = lib.encode(t)
        assert ids.decode() == ",".join(map(str, want)) and decoded.decode() == lib.decode(want)


def test_pieces_heap_equals_matrix():
    v = pieces.vocabulary(PIECES)
    for t in ("▁international", "▁aaaaaaaa", "▁été", "▁日本x"):
        assert v.long(t) == v.rows([t])[0]


def test_pieces_query(spark):
    got = {r.doc_id: r for r in pieces.digests(edge_docs(spark), PIECES).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 6 and got[1].n_tokens == 0 and got[1].ids_sha256 == got[1].decoded_sha256 == got[2].ids_sha256 == empty
    lib = pieces.vocabulary(PIECES).library
    assert got[7].n_tokens == len(lib.encode("word " * 30000)) and got[7].decoded_sha256 == hashlib.sha256(("word " * 30000).encode()).hexdigest()
    text = {r.doc_id: r for r in pieces.code(edge_docs(spark), PIECES).collect()}
    assert text[5].decoded == "a b c d e f"


def test_pieces_check_finds_a_difference():
    c = pieces.Coder(PIECES)
    c.vocabulary = type("Wrong", (), {"__getattr__": lambda self, k: getattr(pieces.vocabulary(PIECES), k), "encode": lambda self, x: [[5]] * len(x)})()
    with pytest.raises(ValueError):
        c.texts(["hello there"])


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    for n in (0, 1, 63, 64, 777):
        x = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint32)
        data = packing.pack(x, bits)
        assert len(data) == (n * bits + 7) // 8 and (packing.unpack(data, bits, 0, n) == x).all()
        assert (packing.unpack(data, bits, n // 3, n // 2) == x[n // 3:n // 2]).all()
    assert packing.width(50257) == 16 and packing.width(2) == 1 and packing.width(1) == 1


def test_packing_encodes_like_library():
    e = packing.Encoder(BYTES)
    texts = odd_texts()
    for t, ids in zip(texts, e.texts(texts)):
        assert np.frombuffer(ids, e.kind).tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_packed_files(spark, tmp_path):
    texts = corpus(n=40)
    df = docs(spark, texts).repartition(5)
    packing.write(df, BYTES, str(tmp_path / "ids"), end=0)
    lib = packing.encoder(BYTES).library
    start = 0
    got = {r.doc_id: r for r in packing.digests(spark, str(tmp_path / "ids")).collect()}
    ids = {r.doc_id: r.ids for r in packing.tokens(spark, str(tmp_path / "ids")).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t, add_special_tokens=False).ids + [0]
        assert ids[i] == want
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    edge = packing.written_digests(edge_docs(spark), BYTES)
    assert sorted(r.n_tokens for r in edge.collect())[:2] == [1, 1] and edge.count() == 7
    assert packing.written_digests(edge_docs(spark).limit(0), BYTES).count() == 0


def test_phrases_equal_brute_force(spark):
    r = random.Random(4)
    item = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    items = [(1, item(30)), (2, item(13)), (3, "alpha BETA"), (4, ""), (5, None), (6, item(5)), (None, item(14)), (2, item(15))]
    texts = []
    for i in range(60):
        w = [r.choice(WORDS + ["x%d" % r.randint(0, 50)]) for _ in range(r.randint(0, 60))]
        src = (r.choice(items)[1] or "").split()
        a = r.randint(0, max(0, len(src) - 14))
        at = r.randint(0, len(w))
        texts.append(" ".join(w[:at] + src[a:a + r.randint(1, 30)] + w[at:]).replace("x1", "X-1!"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in phrases.contamination(docs(spark, texts), table).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for i, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for id_, text in items:
            own = words(text)
            n = min(13, len(own))
            for s in range(len(own) - n + 1) if n else []:
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == own[s:s + n]:
                        hit.update(range(p, p + n))
                        ids |= {str(id_)} if id_ is not None else set()
        g = got[i]
        assert (g.n_words, g.n_hit, g.n_items) == (len(w), len(hit), len(ids)), i
        assert g.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert g.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    kept = {x.doc_id for x in phrases.keep_clean(docs(spark, texts), table).collect()}
    assert kept == {i for i, g in got.items() if not g.contaminated}


def test_phrases_edges_and_proximity(spark):
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "zz yy")], "item_id long, text string")
    got = phrases.contamination(edge_docs(spark), items).collect()
    assert len(got) == 7 and sum(r.contaminated for r in got) == 3
    assert phrases.contamination(edge_docs(spark), items.limit(0)).where("n_hit > 0").count() == 0
    near = phrases.proximity(docs(spark, ["yy one two zz", "zz " + "x " * 20 + "yy"]), items, slop=3)
    assert [(r.doc_id, r.item_id, r.pos) for r in near.collect()] in ([(0, "2", 0)], [(0, "2", 3)])


def test_line_passages(spark):
    block = ["The first shared line of text.", "The second shared line.", "And a third one follows here.", "The fourth one ends it.", "Or is it the fifth?", "Yes it is."]
    long = " ".join(f"w{i}" for i in range(60))
    texts = ["\n".join(["head one", *block, "tail one"]), "\n".join(["other head", "more", *block, "other tail"]), "\n".join(["lead", long, "after"]),
             "\n".join(["x", long, "y"]), "tail one\nalone", "\n\n\n", "\n\n\n", "short\nline"]
    got = {r.doc_id: r for r in lines.drop_repeats(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    left = got[1].text.split("\n")
    assert got[1].n_removed == 9 - len(left) and got[1].n_removed >= 2 and {"other head", "more", "other tail"} <= set(left)
    assert got[2].n_removed == 0 and got[3].text == "x\ny"
    assert all(got[i].text == texts[i] for i in (4, 5, 6, 7))
    assert lines.drop_repeats(docs(spark, texts)).columns[:5] == [c.split()[0] for c in DOCS.split(", ")]


def test_line_passages_of_copies_and_edges(spark):
    text = "\n".join(f"line number {i} of a document" for i in range(9))
    got = {r.doc_id: r for r in lines.drop_repeats(docs(spark, [text, "new first line\n" + text, text])).collect()}
    assert got[0].n_removed == 0 and got[2].n_removed == 9 and got[1].text == "new first line"
    assert {r.doc_id for r in lines.without_emptied(docs(spark, [text, "new first line\n" + text, text])).collect()} == {0, 1}
    edge = lines.drop_repeats(edge_docs(spark)).collect()
    assert len(edge) == 7 and not any(r.n_removed for r in edge) and [r.text for r in edge if r.doc_id == 1] == [None]
    assert lines.drop_repeats(edge_docs(spark).limit(0)).count() == 0


def brute_passages(texts):
    """Lines of every span of 50 words or more whose text an earlier document holds as a span."""
    first, gone = {}, {}
    for i, text in enumerate(texts):
        own = text.split("\n")
        for a in range(len(own)):
            for b in range(a, len(own)):
                span = "\n".join(own[a:b + 1])
                if len(span.split()) >= 50 and own[a].split() and own[b].split() and first.setdefault(span, i) != i:
                    gone.setdefault(i, set()).update(range(a, b + 1))
    return {i: sorted(x) for i, x in gone.items()}


def test_planted_line_passages_equal_brute_force(spark):
    r, n = random.Random(5), itertools.count()
    line = lambda k: " ".join(f"w{next(n)}" for _ in range(k))
    passages = []
    for size in (2, 3, 4, 5, 6):
        for _ in range(12):
            words = [1] * size
            for _ in range(60 - size):
                words[r.randrange(size)] += 1
            passages.append([line(k) for k in words] if r.random() < 0.8 else [line(words[0]), "", *(line(k) for k in words[1:])])
    passages += [[line(45), line(5), line(4), line(3)], [line(3), line(4), line(5), line(45)], [line(5), line(70), line(5)], [line(1) for _ in range(55)]]
    texts = []
    for _ in range(3):
        for p in r.sample(passages, len(passages)):
            texts.append("\n".join([*(line(r.randint(1, 12)) for _ in range(r.randint(0, 4))), *p, *(line(r.randint(1, 12)) for _ in range(r.randint(0, 4)))]))
    texts += ["\n".join([*passages[0], *passages[30]]), "\n".join([line(9), *passages[30], *passages[0], line(2)]), "a b\nc d\n" + line(50), "a b\nc d"]
    want = brute_passages(texts)
    assert len(want) > 120
    often = Counter(s for t in texts for s in t.split("\n"))
    for cut in (lines.drop_repeats, lines.without_emptied):  # the query's operator, and the pipeline's stage
        rows = cut(docs(spark, texts)).collect()
        for x in rows:
            left = [s for k, s in enumerate(texts[x.doc_id].split("\n")) if k not in want.get(x.doc_id, [])]
            found = set(x.text.split("\n")) if x.text else set()
            assert {s for s in left if often[s] == 1} <= found <= set(left)
        assert len(rows) >= len(texts) - len(want)


def test_runs_of_equal_hashes_and_unequal_bytes_stay(spark, monkeypatch):
    """With hashes that tell nothing apart, only stretches equal byte by byte go."""
    same = "\n".join(f"same words of line {i} here" for i in range(12))
    texts = [same, "\n".join(f"other words of line {i} here" for i in range(12)), "head\n" + same]
    stretches = lines._stretches
    monkeypatch.setattr(lines, "_stretches", lambda d: stretches(d).selectExpr("key", "doc_id", "a", "b", "0L as k1", "cast(b - a as bigint) as k2"))
    got = {r.doc_id: r for r in lines.drop_repeats(docs(spark, texts)).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed == 0


def test_long_passages_of_like_lines_keep_one(spark):
    text = "\n".join(["ten words " * 5] * 30)
    got = {x.doc_id: x for x in lines.drop_repeats(docs(spark, [text, "head\n" + text, "a\n\n" + text])).collect()}
    assert got[0].text.split("\n") and set(got[0].text.split("\n")) == {"ten words " * 5}
    assert got[1].text == "head" and got[2].text.split() == ["a"]
    assert {x.doc_id for x in lines.without_emptied(docs(spark, [text, "\n\n" + text])).collect()} == {0}


def test_url_verdicts(spark):
    link = "<html><head><link rel='canonical' href='{}'></head></html>"
    fresh = '<meta http-equiv="refresh" content="0; url={}">'
    pages = spark.createDataFrame([
        (1, "http://A.Example.org/es/x?q=1", ""), (2, "https://b.example.net/p", link.format("http://example.org/es/y")), (3, "https://c.example.net/p", fresh.format("//b.example.net/p")),
        (4, "http://example.org/fr", link.format("/es/z")), (5, "http://free.net", None), (6, None, None), (7, "no scheme", ""), (8, "http://d.com/de/", ""), (9, "http://e.com/fr/", ""),
        (10, "http://src.net/", ""), (10, "http://src.net/", "")], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS verdict")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("com", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    redirects = spark.createDataFrame([("http://src.net/", "http://d.com/de/q"), (None, "http://free.net")], "src string, dst string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in aliases.verdicts(pages, rules, redirects).collect())
    assert [(g[0], g[4]) for g in got] == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "block"), (9, "allow"), (10, "block"), (10, "block")]
    assert got[0][1:4] == ("a.example.org", "/es/x", "example.org/es/") and got[4][1:4] == ("free.net", "", None) and got[5][1:3] == ("", "")
    assert aliases.verdicts(pages.limit(0), rules).count() == 0


def test_chat_costs_equal_brute_force():
    r = random.Random(8)
    for _ in range(60):
        roles = [r.randint(0, 3) for _ in range(r.randint(1, 6))]
        cost, path = chat.solve(roles)
        best = min(_brute(roles))
        assert cost == best
        state = chat.START
        for before, after in path:
            assert before == state
            state = after


def _brute(roles):
    """Costs of all legal ways, tried one by one on the written-out sequence."""
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        base = sum(chat.RELABEL for a, b in zip(roles, labels) if a != b)
        for joins in itertools.product(("new", "merge", "insert"), repeat=len(roles)):
            seq, cost, ok = [], base, True
            for r, j in zip(labels, joins):
                if j == "merge":
                    ok &= bool(seq) and seq[-1] == r
                    cost += chat.MERGE
                elif j == "insert":
                    seq += [5 - r, r] if r > 1 else [0]
                    cost += chat.INSERT
                else:
                    seq.append(r)
            body = seq[1:] if seq[:1] == [1] else seq
            if ok and all(x == 2 + i % 2 for i, x in enumerate(body)):
                yield cost


def test_chat_repair(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 3)
    r = random.Random(1)
    names = ["user", "assistant", "system", "tool", None, "User "]
    rows = [(c, t, r.choice(names), f"text {c} {t} <|x|>") for c in range(12) for t in range(r.randint(1, 15))] + [(None, 0, "assistant", None), (None, 1, "user", ""), (99, None, "user", "q"), (99, None, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS piece", "2 AS part").repartition(3)
    got = chat.repair(df).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.conv_id, []).append(x)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x.turn is not None, x.turn or 0))
        own = [chat.role_number(x.role) for x in turns]
        assert turns[0].conv_cost == chat.solve(own)[0]
        text = "".join(x.rendered for x in turns)
        heads = re.findall(r"<\|(system|user|assistant|end)\|>", text)
        assert text.endswith("<|end|>\n") and heads[1::2] == ["end"] * (len(heads) // 2)
        body = heads[0::2][1:] if heads[0] == "system" else heads[0::2]
        assert all(h == ("user", "assistant")[i % 2] for i, h in enumerate(body))
    assert chat.repair(df.limit(0)).count() == 0


def toxic_rows(n=260, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(r.randint(20, 150))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w[r.randrange(len(w))] = r.choice(["grumble", "snarl"]) + r.choice(["ly", "ed", "s", ""])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_learns_and_holds_out(spark):
    rows = toxic_rows()
    table = docs(spark, [t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = toxic.train(table, labels)
    got = {r.doc_id: r for r in toxic.score(table, net).collect()}
    aside = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in aside) for i in got)
    right = sum(got[i].predicted == rows[i][2] for i in aside)
    assert right >= 0.9 * len(aside)
    edge = {r.doc_id: r.score for r in toxic.score(edge_docs(spark), net).collect()}
    assert edge[1] == edge[2] == edge[3] == 0.0 and 0 <= edge[7] <= 1
    assert toxic.keep_clean(edge_docs(spark), net).columns == edge_docs(spark).columns
    late = " ".join(["alpha1"] * 2000 + ["grumbleed", "snarl", "grumble"])  # the end of a long text counts
    assert toxic.Scorer(net).scores([late])[0] > toxic.Scorer(net).scores([" ".join(["alpha1"] * 2000)])[0]


def test_toxicity_reads_every_window():
    """The first pass takes every window of a toxic text, the second the highest of all windows of any."""
    r = random.Random(4)
    text = " ".join(f"w{r.randrange(400)}" for _ in range(3000)) + " snarl"
    rows = lambda label: [pa.RecordBatch.from_pylist([{"doc_id": 3, "toxic": label, "text": text}])]
    picked = lambda fn, label: [x["words"] for b in fn(rows(label)) for x in b.to_pylist()]
    every = [" ".join(w) for w in toxic._window_words(text)]
    assert len(every) > 180 and picked(toxic._first_windows, 1) == every and len(picked(toxic._first_windows, 0)) == toxic.CLEAN_WINDOWS
    net = toxic.Network({f"w{i}": i + 1 for i in range(400)})
    value = toxic.logits(net, toxic._window_words(text))
    ranked = [every[i] for i in np.argsort(-value, kind="stable")]
    second = toxic._second_windows(type("Shared", (), {"value": net}))
    n = max(1, min(toxic.TOXIC_WINDOWS, int((value > 0).sum())))
    assert picked(second, 1) == ranked[:n] and set(ranked[:toxic.CLEAN_WINDOWS // 2]) <= set(picked(second, 0))


def test_toxicity_single_class_and_gradient(spark):
    table = docs(spark, ["a b", "c d", " "])
    none = toxic.train(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxic.Scorer(none).scores(["a b", None]).tolist() == pytest.approx([0, 0], abs=1e-9)
    one = toxic.train(table, table.selectExpr("doc_id", "1 as toxic"))
    assert toxic.Scorer(one).scores(["a b", "", " "]).tolist() == pytest.approx([1, 0, 0], abs=1e-9)
    assert toxic.score(table.limit(0), none).collect() == []
    net = toxic.Network({"a": 1, "b": 2})
    windows = [["a", "b", "c"], ["b"]]
    words, at = toxic._batches(windows)
    gates = net.projected(net.inputs(words)[0]).astype(np.float64)
    logit, seen = net.forward(gates, at, keep=True)
    _, d = net.backward(np.ones(2, np.float32), seen, at, gates)
    for i in range(2):
        for j in (0, 9, 20):
            up = gates.copy()
            up[i, 1, j] += 1e-2
            down = gates.copy()
            down[i, 1, j] -= 1e-2
            assert (net.forward(up, at).sum() - net.forward(down, at).sum()) / 2e-2 == pytest.approx(d[i, 1, j], abs=2e-3)


def test_window_starts_cover_every_word():
    for n in (0, 1, 16, 17, 32, 33, 100):
        covered = {i for s in toxic.window_starts(n) for i in range(s, min(n, s + toxic.WINDOW))}
        assert covered == set(range(n))
