"""Prefix tries, page texts and vector codes against plain versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Prefix trie


def plain_trie(rows):
    convs = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    nodes = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        turns = (*convs.get(c - c % 5, [])[:h], *convs[c][h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
            if d == len(turns):
                nodes.setdefault(("ends", turns), []).append(c)
    prefixes = [p for p in nodes if p[:1] != ("ends",)]
    children = {}
    for p in prefixes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        own = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        kids = [below(k) for k in children.get(p, [])]
        return (sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids))

    out = set()
    for p in prefixes:
        leaves, saved = below(p)
        ends = ",".join(map(str, sorted(nodes.get(("ends", p), []))))
        out.add((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children.get(p, [])), leaves, saved, sha(ends)))
    return out


def trie(spark, rows, more=""):
    from quillspark.llm.prefixtrie import ordered_turns, prefix_trie, rebuilt

    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int")
    return {tuple(r) for r in prefix_trie(*rebuilt(ordered_turns(frame))).collect()}


def test_trie_odd_rows(spark):
    rows = [(5, 0, "user", "a"), (5, 1, None, "é" * 3), (5, 1, "x", None), (6, None, "user", "first"), (6, 0, "user", "a"), (None, 0, "user", "a"), (7, 3, "u", "t"), (7, 3, "u", "t"), (8, 0, "user", "long " * 20_000), (23, 0, "u", ""), (41, 9, "u", "q")]
    rows += [(c, t, "user", f"w{t}") for c in (100, 105, 110, 115) for t in range(12)]
    assert trie(spark, rows) == plain_trie(rows)
    assert trie(spark, []) == set()
    assert trie(spark, rows[:1]) == plain_trie(rows[:1])
    same = [(c, t, "user", "same") for c in (10, 15, 20) for t in range(6)]
    assert trie(spark, same) == plain_trie(same)


def test_trie_random(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(["u", "a"]), rng.choice("ab")) for c in rng.choices(range(60), k=300)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_long_conversation_is_split_over_partitions(spark):
    from quillspark.llm.prefixtrie import ordered_turns

    rows = [(3, t, "u", f"{t}") for t in range(5000)] + [(c, 0, "u", "x") for c in range(4, 40)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions would become one
    try:
        turns = ordered_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(8))
        got = turns.filter("conv_id = 3").orderBy("pos").select("pos", "bytes", "through").collect()
        assert [r[0] for r in got] == list(range(5000)) and [r[2] for r in got] == list(itertools.accumulate(r[1] for r in got))
        placed = {f.rsplit("/", 1)[0] for f in turns.inputFiles() if "placed" in f}
        assert spark.read.parquet(*placed).filter("conv_id = 3").select("part").distinct().count() > 1
        few = [r for r in rows if r[0] != 3] + rows[:40]
        assert trie(spark, few) == plain_trie(few)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# Minimum cut and page texts


def cut_cost(side, terminal, edges):
    return sum(max(0, t) if not s else max(0, -t) for s, t in zip(side, terminal, strict=True)) + sum(c for u, v, c in edges if side[u] != side[v])


def test_min_cut_against_all_labellings():
    from quillspark.llm.mincut import min_cut

    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 9)
        terminal = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 7)) for _ in range(rng.randint(0, 18))]
        least = min(cut_cost(s, terminal, edges) for s in itertools.product((False, True), repeat=n))
        assert cut_cost(min_cut(terminal, edges), terminal, edges) == least


def test_min_cut_of_long_chain():
    from quillspark.llm.mincut import min_cut

    rng = random.Random(3)
    terminal = [rng.randint(-3, 3) for _ in range(3000)]
    edges = [(i, i + 1, 2) for i in range(2999)]
    best = [0, 0]
    for i, t in enumerate(terminal):
        stay = [min(best[s], best[1 - s] + 2) if i else 0 for s in (0, 1)]
        best = [stay[0] + max(0, t), stay[1] + max(0, -t)]
    assert cut_cost(min_cut(terminal, edges), terminal, edges) == min(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/a">One</a><li><a href='/b'>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, on this site, to make it better for you.</div><!-- <p>no</p> -->
<%s><h1>Head &amp; line&amp</h1><p><b>First  of
them.<br><p>Second &eacute;&#233;&nbsp;x, with <a href="/x">a link</a> in it.</p><div class="ad">Buy this fine thing now, it is very good.</div>
<ul><li>Item one<li>Item two</ul><table><tr><td>c1<td>c2</table><form><label>Your name</label><input><button>Send</button></form>
<p>Short</p><section id="comments"><article><p>I like this article very much, thank you for it.</p></article></section></%s>
<aside><h3>More</h3><p>Other articles that you may like to read as well.</p></aside><footer>&copy; Somebody</footer>"""
WANT = "Head & line&\nFirst of them.\nSecond éé x, with a link in it.\nItem one\nItem two\nc1\nc2\nShort"


def test_page_text(spark):
    from quillspark.llm.pagetext import extract, fit_shapes

    long = "<article>" + "<div>" * 30_000 + "<p>deep words here.</p>" + "</div>" * 30_000 + "<p>" + "many words " * 20_000 + "</article>"
    rows = [
        (1, "u", PAGE % ("article", "article"), WANT), (1, "u", PAGE % ("article", "article"), WANT), (2, "v", PAGE % ("main", "main"), WANT), (3, None, None, ""), (4, "x", "", ""), (None, "y", "<article>a &lt; b", "a < b"),
        (6, "z", "< 3 and <article><p>x<y>z</p", "x z".replace(" ", "")), (7, "w", long, "deep words here.\n" + " ".join(["many words"] * 20_000)), (8, "n", "<nav>a</nav><script>", ""), (9, "c", "<article><p>kept</p><!-- rest <p>gone</p>", "kept"),
    ]
    frame = spark.createDataFrame([(*r[:3], "t") for r in rows], "page_id bigint, url string, html string, text string")
    found = sorted(map(tuple, extract(frame, fit_shapes(frame)).select("page_id", "url", "text", "n_chars").collect()), key=repr)
    assert found == sorted(((i, u, w, len(w)) for i, u, _, w in rows), key=repr)
    assert extract(frame.limit(0), fit_shapes(frame.limit(0))).count() == 0


def test_page_text_without_marks(spark):
    """Pages that say nothing of their parts: the classifier and the neighbours decide. Accuracy by words."""
    from quillspark.llm.pagetext import fit_shapes, main_blocks

    rng = random.Random(9)
    sentence = lambda n: (" ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(n)) + ".").capitalize()
    weights = fit_shapes(spark.createDataFrame([(i, "u", "<nav><a href='/'>home</a></nav><article><h1>Head of it</h1>" + "".join(f"<p>{sentence(15)}</p>" for _ in range(4)) + "</article><footer>© x</footer>") for i in range(50)], "page_id bigint, url string, html string"))
    right = whole = 0
    for _ in range(60):
        menu = "".join(f"<li><a href='/'>{sentence(2)[:-1]}</a></li>" for _ in range(6))
        body = [sentence(rng.choice([4, 12, 25, 40])) for _ in range(rng.randint(4, 9))]
        page = f"<div><ul>{menu}</ul></div><div>" + "".join(f"<p>{b}</p>" for b in body) + f"</div><div><span>© {sentence(3)[:-1]}</span></div><div><a href='/'>{sentence(3)[:-1]}</a></div>"
        got = main_blocks(page, weights)
        right += len(set(got) & set(body)) * 2
        whole += len(got) + len(body)
    assert right / whole > 0.97


# Vector codes


def plain_codes(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    if not kept:
        return set(), sha("")
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    at = [i * len(kept[0][1]) // parts for i in range(parts + 1)]
    books = [[r[1][at[p] : at[p + 1]] for r in kept[:entries]] for p in range(parts)]
    nearest = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for r in kept:
                mine.setdefault(nearest(books[p], r[1][at[p] : at[p + 1]])[1], []).append(r[1][at[p] : at[p + 1]])
            for e, xs in mine.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(books[p], v[at[p] : at[p + 1]]) for p in range(parts)]
        out.append((i, label, tuple(e for _, e in found), sum(d for d, _ in found)))
    sums = {}
    for r in out:
        sums[r[1]] = sums.get(r[1], 0) + r[3]
    return sorted(((*r[:3], min(r[3], 2**63 - 1), min(2**63 - 1, sums[r[1]])) for r in out), key=repr), sha(",".join(str(x) for b in books for c in b for x in c))


def codes(spark, rows, **more):
    from quillspark.llm.vectorcode import codebooks_digest, encode, with_label_error

    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, error int").repartition(3)
    coded, books = encode(frame, **more)
    return sorted(((r["vec_id"], r["label"], tuple(r["code"]), r["error"], r["label_error"]) for r in with_label_error(coded).collect()), key=repr), codebooks_digest(books)


@pytest.mark.parametrize("size", [1.0, 3e9, 1e30])
def test_codes(spark, size):
    rng = random.Random(5)
    near = [[rng.gauss(0, size) for _ in range(10)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, size / 10) for x in rng.choice(near)], rng.choice([None, 1, 2])) for i in range(3, 120)]
    rows += [(1, None, 1), (2, [None] * 10, 1), (0, [float("nan")] * 10, 1), (500, [float("inf")] + [0.0] * 9, 2), rows[0], rows[0], (None, [0.0] * 10, 3), (501, [0.0] * 10, None)]
    assert codes(spark, rows, entries=16) == plain_codes(rows, entries=16)


def test_codes_of_few_rows(spark):
    rows = [(7, [0.5, -0.5, 0.25, 0.0], None), (8, [0.5, -0.5, 0.25, 0.1], 1)]
    assert codes(spark, rows) == plain_codes(rows)
    assert codes(spark, [(1, None, 1)]) == ([], sha(""))
    assert codes(spark, [*rows, (9, [1.0], 1)]) == plain_codes(rows)
    assert codes(spark, [(1, [], 1)])[0] == [(1, 1, (0, 0, 0, 0), 0, 0)]


def test_filter_leaves_few_candidates():
    from quillspark.llm.vectorcode import CellFile

    rng = np.random.default_rng(1)
    entries, queries = rng.integers(-400, 400, (256, 16)), rng.integers(-400, 400, (500, 16))
    for bits in (1, 3, 5):
        file = CellFile(entries, bits)
        distance = ((queries[:, None] - entries[None]) ** 2).sum(2)
        index, best = file.nearest(queries)
        assert (index == distance.argmin(1)).all() and (best == distance.min(1)).all()
    assert CellFile(entries, 5).candidates(queries).mean() < 0.15
