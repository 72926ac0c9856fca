"""The corpus operators against brute force, round trips and odd inputs."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import common, components, golay, hosts, html, leaks, packing, plans, quotes, sequences, shuffle, simhash, urls, warc
from quantloom.llm.encoding import Encoder, vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BPE, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
LONG = "Lorem ipsum dolor sit amet. " * 20_000


def text(rng, n, vocabulary_size=300):
    return " ".join(f"w{rng.randint(0, vocabulary_size)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows and null ids."""
    rng = random.Random(3)
    base = [text(rng, rng.randint(60, 300), 5000) for _ in range(60)]
    near = [" ".join("changed" if i in (7, 90) else w for i, w in enumerate(t.split())) for t in base[:8]]
    texts = [*base, *base[:5], *near, None, "", "   \n", "one", "one two", LONG, "a b c " * 80]
    rows = [(i, t, "en", f"s{i % 3}" if i % 10 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, base[9], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def empty(spark, ddl=DOCS):
    return spark.createDataFrame([], ddl)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# -- encoding and packing ---------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BPE, WORDS])
def test_encoder_equals_library(path):
    rng, e = random.Random(5), Encoder(path)
    pool = " \n\t\r  ab'sÉé  ́ ​\x1c\x85　.,12<|endoftext|>日本ſΣς'llÀ×÷_^`ÿßI"
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        for case in (t, t + "<|endoftext|> b", f"word. {t}\nNext, {t}"):
            assert e.encode(case) == e._ids(case)


def test_packing_is_a_partition_of_all_ids(spark, docs):
    out = rows_of(packing.pack_documents(docs, BPE))
    e = Encoder(BPE)
    want = Counter()
    for r in docs.collect():
        ids = e.encode(r.text or "") + bytes(4)
        n = len(ids) // 4
        cuts = [0, *range(n % 2048 or min(n, 2048), n + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r.doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    volume = -(-sum(r["length"] for r in out) // 2048)
    assert len(bins) <= volume + 1
    lengths = np.array([r["length"] for r in out])
    plain = packing.founders(lengths, 2048, 1, np.random.default_rng(0))[0]
    assert len(bins) <= plain.max() + 1
    assert packing.pack_documents(empty(spark), BPE).count() == 0


def test_genetic_operators_keep_packings_whole():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 700)
    population = packing.founders(lengths, 2048, 4, rng)
    for _ in range(20):
        child = packing.crossover(population[0], population[1], lengths, 2048, rng)
        assert child.min() == 0 and np.bincount(child, weights=lengths).max() <= 2048 and (np.bincount(child) > 0).all()
        population = [child, population[0]]
    best = packing.evolve(packing.founders(lengths, 2048, 4, rng), lengths, 2048, 3, rng)
    assert packing.fitness(best[0], lengths, 2048) >= packing.fitness(packing.founders(lengths, 2048, 1, rng)[0], lengths, 2048)


def test_bulk_best_fit_equals_item_by_item():
    rng = np.random.default_rng(4)
    for high, n in ((30, 400), (2048, 900), (5, 300), (700, 3000)):
        lengths = rng.integers(1, high, n)
        table = sorted(packing.bulk_best_fit(dict(Counter(lengths.tolist())), 2048))
        bins = defaultdict(int)
        for k, (length, rank, each, first) in enumerate(table):
            end = table[k + 1][1] if k + 1 < len(table) and table[k + 1][0] == length else int((lengths == length).sum())
            for r in range(rank, end):
                bins[first + (r - rank) // each] += length
        plain = packing.founders(lengths, 2048, 1, rng)[0]
        assert sorted(bins.values()) == sorted(np.bincount(plain, weights=lengths).astype(int).tolist())


def test_packing_is_as_tight_as_plain_best_fit(spark):
    """Several blocks and rounds, with lengths that fill bins and with some that don't."""
    rng = np.random.default_rng(9)
    for lengths in (rng.integers(1, 900, 9000), np.concatenate([rng.integers(680, 1400, 9000), rng.integers(1, 60, 3000)])):
        df = spark.createDataFrame([(int(i), int(n), "x") for i, n in enumerate(lengths)], "id int, length bigint, uid string")
        out = rows_of(packing.pack(df))
        bins = defaultdict(int)
        for r in out:
            bins[r["sequence_id"]] += r["length"]
        plain = packing.founders(lengths, 2048, 1, rng)[0]
        assert max(bins.values()) <= 2048 and len(out) == len(lengths) and {r["uid"] for r in out} == {"x"}
        assert len(bins) <= plain.max() + 1


# -- fingerprints -----------------------------------------------------------------------------------


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_golay_code():
    words = np.arange(1 << 23, step=37)
    assert len(np.unique(golay.decode(np.arange(1 << 23)))) == 4096
    near = golay.near_keys(words[:2000])
    plain = golay.decode(words[:2000])
    for bit in range(23):
        flipped = words[:2000] ^ (1 << bit)
        assert (near == golay.decode(flipped)[:, None]).any(axis=1).all()
        for other in range(bit):
            both = golay.near_keys(flipped ^ (1 << other))
            assert (near[:, :, None] == both[:, None, :]).any(axis=(1, 2)).all()
    assert (near == plain[:, None]).any(axis=1).all()


def test_fingerprint_groups_against_brute_force(spark, docs):
    out = rows_of(simhash.fingerprint_groups(docs))
    table = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    prints = sorted({f for _, f in table})
    group = brute_components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for d, f in table:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    want = Counter((d, f"{f:016x}", least.get(group[f])) for d, f in table)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == want
    assert simhash.fingerprint_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("long", [False, True])
def test_close_groups_lose_no_link(spark, long):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for p in prints[:100]:
        for n in (1, 2, 3, 3, 3, 4):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    ball = rng.getrandbits(64)
    prints += [ball ^ sum(1 << b for b in rng.sample(range(10), rng.randint(0, 5))) for _ in range(300)]
    signed = sorted({int(np.array([p], dtype=np.uint64).view(np.int64)[0]) for p in prints})
    u = lambda x: x & (2**64 - 1)
    links = [(a, b) for a in signed for b in signed if a < b and (u(a) ^ u(b)).bit_count() <= 3]
    got = {r.node: r.component for r in simhash.close_groups(spark.createDataFrame([(p,) for p in signed], "fp bigint"), long=long).collect()}
    want = brute_components(signed, links)
    assert got == {x: want[x] for link in links for x in link}
    left, right = ([set(row) for row in simhash.keys_of(np.array(signed), long, side).tolist()] for side in (0, 1))
    at = {p: i for i, p in enumerate(signed)}
    assert all(left[at[a]] & right[at[b]] and left[at[b]] & right[at[a]] for a, b in links)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (2000, 1999)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 5 or v != 5}


def test_near_copies(spark, docs):
    kept = rows_of(simhash.drop_near_copies(docs))
    sets = {}
    for r in docs.collect():
        sets.setdefault((r.doc_id, r.text), simhash.shingle_set(r.text or "", 5))
    keys = list(sets)
    arrays = [sets[k] for k in keys]
    links = []
    for i in range(len(keys)):
        for j in range(i):
            both = len(np.intersect1d(arrays[i], arrays[j]))
            union = len(arrays[i]) + len(arrays[j]) - both
            if union == 0 or both / union >= 0.8:
                links.append((j, i))
    group = brute_components(range(len(keys)), links)
    assert len(kept) == len(set(group.values()))
    order = lambda k: (k[0] is not None, k[0] or 0)
    want = Counter()
    for g in set(group.values()):
        members = [keys[i] for i in group if group[i] == g]
        want[min(members, key=order)[0]] += 1
    assert Counter(r["doc_id"] for r in kept) == want
    assert simhash.drop_near_copies(empty(spark)).count() == 0


def test_near_copies_of_the_small_table(spark):
    """Whole table, against counting what every two sets share."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[i][0] for i in brute_kept([t for _, t in rows])}
    assert {r["doc_id"] for r in rows_of(simhash.drop_near_copies(docs))} == want


def test_text_that_goes_on_is_no_copy(spark):
    rng = random.Random(13)
    start = "alpha beta gamma " * 300
    rows = [(1, start, "en", "s", 0), (2, start + text(rng, 120, 10**6), "en", "s", 0)]
    assert {r["doc_id"] for r in rows_of(simhash.drop_near_copies(spark.createDataFrame(rows, DOCS)))} == {1, 2}


def test_equal_fingerprints_are_no_copies(spark):
    rng = random.Random(12)
    line, rows = "this line comes again here".split(), []
    for d in range(6):
        own = text(rng, 2750, 10**6).split()
        rows.append((d, " ".join(own[:2000] + line * 450 + own[2000:]), "en", "s", 0))
    prints = {simhash.fingerprint(r[1]) for r in rows}
    assert len(prints) < len(rows)
    assert {r["doc_id"] for r in rows_of(simhash.drop_near_copies(spark.createDataFrame(rows, DOCS)))} == set(range(6))


def brute_kept(texts, similarity=0.8):
    """Least positions of the groups, by counting what every two sets share."""
    sets = [simhash.shingle_set(t, 5) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s.tolist():
            holders[h].append(i)
    alone = np.array([sum(len(holders[h]) == len(sets) for h in s.tolist()) for s in sets])
    everywhere, both, links = int(alone.min()), Counter(), []
    for h in holders.values():
        if len(h) < len(sets):
            both.update((a, b) for k, b in enumerate(h) for a in h[:k])
    for (a, b), n in both.items():
        n += everywhere
        if n / (len(sets[a]) + len(sets[b]) - n) >= similarity:
            links.append((a, b))
    return set(brute_components(range(len(texts)), links).values())


def test_twins_around_a_shared_passage(spark):
    rng = random.Random(21)
    passage, texts = text(rng, 300, 10**6), []
    for _ in range(1500):
        own = text(rng, 60, 10**6).split()
        texts.append(f"{passage} {' '.join(own)}")
        for at in rng.sample(range(4, 56), 4):
            own[at] = "changed"
        texts.append(f"{passage} {' '.join(own)}")
    want = brute_kept(texts)
    assert 1500 <= len(want) < 1600
    got = rows_of(simhash.drop_near_copies(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)))
    assert sorted(r["doc_id"] for r in got) == sorted(want)


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(6)
    for n in (1, 5, 60, 400, 9000):
        for _ in range(60):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            gone = int(rng.integers(0, n // 4 + 1))
            y = np.concatenate([x[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1)), dtype=np.uint64)])
            both = n - gone
            if both / (n + len(y) - both) >= 0.8:
                assert simhash.may_be_alike(simhash.sketch(x), simhash.sketch(y), 0.8)
    far = [simhash.sketch(rng.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(2)]
    assert not simhash.may_be_alike(*far, 0.8)


def test_copies_that_repeat_a_line(spark):
    rng = random.Random(31)
    texts = []
    for _ in range(30):
        own, line = text(rng, 300, 10**6).split(), text(rng, 12, 10**6).split()
        texts += [" ".join(own + line), " ".join(own + line * 24)]
    kept = rows_of(simhash.drop_near_copies(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)))
    assert brute_kept(texts) == {*range(0, 60, 2)} == {r["doc_id"] for r in kept}


# -- archives ---------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def test_archive_round_trip(spark):
    body = "<p>é" + "x" * 3000
    rows = [(i, f"http://a/{i}\r\nX: y", body + str(i % 40)) for i in range(200)] + [(900, None, None), (901, "u", ""), (902, "http://b", LONG)]
    out = {r["page_id"]: r for r in rows_of(warc.archive_pages(spark.createDataFrame(rows, PAGES).repartition(3), payloads=True))}
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    assert len(out) == len(rows)
    for i, _, h in rows:
        data, last, r = (h or "").encode(), max(groups[h or ""]), out[i]
        import base64
        import hashlib

        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == last else ("revisit", last))
        assert r["payload"] == (data if i == last else None)
    assert warc.archive_pages(empty(spark, PAGES)).count() == 0


def test_broken_archives_are_errors(tmp_path):
    path = tmp_path / "a.warc.zst"
    writer = warc.ArchiveWriter(open(path, "wb"))
    for i in range(3):
        writer.add(warc.record(i, "http://a", b"payload"))
    writer.close()
    data = path.read_bytes()
    import io

    assert len([warc.parse_record(r) for r in warc.frames(io.BytesIO(data))]) == 3
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"\x28\xb5\x2f\xfd" + data[4:])))
    good = warc.record(1, "http://a", b"payload")
    for bad in (good.replace(b"payload", b"paYload"), good[:-1], good.replace(b"WARC/1.1", b"HARC/1.1")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# -- pages ------------------------------------------------------------------------------------------


def test_main_text():
    page = (
        "<html><head><title>x</title></head><body><header class='site'><h1>Site</h1></header><nav>Home <a>b</a></nav><div class=cookie-notice>We use cookies</div>"
        "<main><article><h1>T&eacute;</h1><p>One <a href=x>two</a> thr<b>ee</b>.<p>Four&nbsp;five<div class='ad'>buy it now</div><form><label>Name</label></form>"
        "<ul><li>a<li>b</ul><script>var t='</p>'</script><section id=comments><p>a reader wrote this</section></article><aside>side</aside></main><footer>c</footer></body></html>"
    )
    assert html.main_text(page) == "Té One two three. Four five a b"
    assert html.main_text("") == "" and html.main_text("<<<>>< a <b") is not None
    many = "<div><p>" + "word " * 60 + "</p><p>" + "more " * 60 + "</p></div><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul>"
    assert html.main_text(many) == " ".join(["word"] * 60 + ["more"] * 60)


@pytest.mark.parametrize(("page", "want"), [
    ('<div class="content has-sidebar"><article><p>one two</p></article></div>', "one two"),
    ('<div class="sidebar-layout"><article><p>one two</p></article></div>', "one two"),
    ('<article><p title="the hidden truth">seen</p><p hidden>unseen</p><p style="color:red; display: none">unseen</p></article>', "seen"),
    ('<article><p data-x="(5,000 characters) > leaked text">kept</p></article>', "kept"),
    (f"<article><p data-x='{'y>' * 9000}'>kept</p><svg><path d=\"{'M0 > ' * 3000}\"></svg></article>", "kept"),
    ("<article><p it's>a quote's mark</p><p x='y>open</article>", "a quote's mark open"),
    ("<article><p>one<br>two</p><!-- > no --><!--> three <p>four</article><!-- never closed <p>five", "one two three four"),
    ("<article><h1>T</h1><p><a href=a>all</a> <a href=b>links</a></p><li>x</article>", "T all links x"),
    ("<article><p>text</p><ol class=commentlist><li class=comment><article class='comment'><p>reader</p></article></ol></article><p>after</p>", "text"),
    ("<article><p>a<script>if (1 < 2) '</p>'</script>b</p><style>p{}</style><textarea>c</textarea></article>", "a b"),
    ("<article><a href=x><div>block in a link</div></a><p>end", "block in a link end"),
])
def test_pages_that_are_easily_misread(page, want):
    assert html.main_text(page) == want


def test_blocks_against_the_standard_parser():
    """Blocks of made-up pages equal those of another parser: text between the tags that end a block."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.blocks, self.skip, self.void = [], [], 0, html.VOID

        def end_block(self):
            words = "".join(self.parts).split()
            self.blocks += [" ".join(words)] if words else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag not in html.INLINE:
                self.end_block()
            self.skip += tag in html.DROPPED and tag not in html.VOID

        def handle_endtag(self, tag):
            if tag not in html.INLINE:
                self.end_block()
            self.skip -= tag in html.DROPPED and tag not in html.VOID

        def handle_data(self, data):
            if not self.skip:
                self.parts.append(data)

    rng = random.Random(77)

    def made(depth):
        kind = rng.choice(["text", "text", "inline", "block", "void", "dropped", "comment"] if depth < 6 else ["text"])
        if kind == "text":
            return rng.choice(["one  two", " three\n", "&amp; four&#233; ", "5 &lt; 6", "é", "\tseven&nbsp;8 "])
        inner = "".join(made(depth + 1) for _ in range(rng.randint(0, 3)))
        extra = rng.choice(["", ' class="x y"', " title='a > b'", ' data-a="it\'s" checked', f' style="{"z" * rng.choice([3, 5000])}"'])
        if kind == "inline":
            tag = rng.choice(["b", "a", "span", "em", "code"])
            return f"<{tag}{extra}>{inner}</{tag}>"
        if kind == "block":
            tag = rng.choice(["div", "section", "h2", "blockquote", "pre", "ARTICLE"])
            return f"<{tag}{extra}>{inner}</{tag}>"
        return {"void": rng.choice(["<br>", "<hr/>", '<img alt="p > q" src=x>']), "dropped": "<script>a < b && c</script>", "comment": "<!-- <p>not</p> -->"}[kind]

    for _ in range(400):
        page = "".join(made(0) for _ in range(8))
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.end_block()
        assert [b.text for b in html.blocks_of(page)] == plain.blocks, page


@pytest.mark.parametrize("piece", ["<b>word ", "<a href=x>word ", "<div>word ", "<p><i>word ", "<li>word ", "<span class=ad>word ", "<p x='>word ", "<!-- word ", "<ul><li><div>word ", "</div>word ", "<td>word ", "<script>word "])
def test_pages_take_time_in_proportion(piece):
    import time

    def seconds(n):
        page = piece * n
        began = time.process_time()
        html.blocks_of(page)
        return time.process_time() - began

    seconds(2000)
    assert min(seconds(40_000) for _ in range(2)) < 40 * max(0.01, min(seconds(4000) for _ in range(3)))


def test_tree_on_held_out_pages():
    pages = html.labelled_pages()

    def held_out(*without):
        hits = n = 0
        for name in pages:
            (x, y), (z, want) = html.labelled([p for k, p in pages.items() if k != name]), html.labelled([pages[name]])
            for f in without:
                x[:, html.FEATURES.index(f)] = z[:, html.FEATURES.index(f)] = 0
            hits, n = hits + (html.predict(html.grow(x, y), z) == want).sum(), n + len(want)
        return hits / n

    assert held_out() >= 0.93
    assert held_out("named") >= 0.85


def test_tree_keeps_whole_articles():
    """Whatever the words and links of a block and its neighbours: in an article it is main text, in boilerplate it is not."""
    rng = np.random.default_rng(3)
    x = np.column_stack([*(rng.integers(1, 300, 3000) if "words" in f else rng.random(3000) * (rng.random(3000) < 0.7) for f in html.FEATURES[:6]), np.ones(3000), np.zeros((3000, 2))])
    assert html.predict(html.trained(), x).all()
    for column in (7, 8):
        y = x.copy()
        y[:, column] = 1
        assert not html.predict(html.trained(), y).any()
    x[:, 6], x[:, 7] = 0, 1  # beside an article
    assert not html.predict(html.trained(), x).any()


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "clash"), (None, None, "<article><p>a  b</article>", "clash"), (1, "u", None, "clash")], f"{PAGES}, text string")
    assert sorted((r["text"], r["n_chars"]) for r in rows_of(html.extract(pages))) == [("", 0), ("", 0), ("a b", 3)]
    assert html.extract(empty(spark, PAGES)).count() == 0


# -- sequences --------------------------------------------------------------------------------------


def test_sequence_files(spark, docs, tmp_path):
    out = sorted(rows_of(sequences.tokenise(docs, WORDS, sequence=64)), key=lambda r: r["start"])
    e, at, want = Encoder(WORDS), 0, Counter()
    for r in docs.collect():
        ids = e.encode(r.text or "") + (2).to_bytes(4, "little")
        want[(r.doc_id, len(ids) // 4, zlib.crc32(ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert sequences.tokenise(empty(spark), WORDS).count() == 0


def test_random_access(tmp_path):
    from pyarrow import fs

    rng, path = np.random.default_rng(2), str(tmp_path / "s.arrow")
    parts = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 700, 0, 5, 3000, 64)]
    writer = sequences.SequenceWriter(fs.LocalFileSystem(), path, np.uint16, 64, 8)
    for i, p in enumerate(parts):
        writer.add(i, p)
    writer.close()
    file, whole = sequences.SequenceFile(fs.LocalFileSystem(), path), np.concatenate(parts)
    assert len(file) == -(-len(whole) // 64)
    for k in range(len(file)):
        assert (file.ids(k)[file.mask(k)] == whole[64 * k : 64 * k + 64]).all() and len(file.ids(k)) == 64
    for (start, n), p in zip(zip(file.docs["start"].to_pylist(), file.docs["n_tokens"].to_pylist()), parts):
        assert (np.concatenate([np.zeros(0, np.uint16), *file.tokens(start, n)]) == p).all()
    file.close()


# -- shards -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("per_task", [7, 1000])
def test_exact_shards(spark, docs, per_task):
    wide = docs.withColumn("slot", F.lit("clash"))
    out = rows_of(shuffle.shuffle_shards(wide, 6, rows_per_task=per_task))
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r.doc_id, r.text) for r in docs.collect())
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(6)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shuffle.shuffle_shards(empty(spark), 6).count() == 0


def test_many_partitions_keep_the_matrix_small(spark):
    sizes = [3] * 5000 + [40_000] + [0] * 10
    limit = shuffle.rows_in_a_part(sum(sizes), 24, 1000)
    pieces = [x for n in sizes for x in [limit] * (n // limit) + [n % limit] if x]
    parts = shuffle.parts_of(pieces, limit)
    blocks = -(-sum(sizes) // (24 * limit))
    assert (parts[-1] + 1) * 24 * blocks <= shuffle.MATRIX_CELLS and parts[-1] < 60
    held = Counter()
    for p, n in zip(parts, pieces):
        held[p] += n
    assert max(held.values()) <= limit and parts == sorted(parts)
    for total in (10**6, 10**9, 10**12):
        limit = shuffle.rows_in_a_part(total, 24, 250_000)
        assert (2 * total // limit + 1) * 24 * -(-total // (24 * limit)) <= shuffle.MATRIX_CELLS
    many = spark.range(0, 3000, numPartitions=300)
    out = rows_of(shuffle.shuffle_shards(many, 24, rows_per_task=100))
    assert sorted(r["id"] for r in out) == list(range(3000)) and set(Counter(r["shard"] for r in out).values()) == {125}


def test_shards_take_evenly_from_every_part(spark):
    out = rows_of(shuffle.shuffle_shards(spark.range(0, 12_000, numPartitions=4), 6, rows_per_task=700))
    met = Counter((r["id"] // 3000, r["shard"], r["slot"] // 1000) for r in out)
    assert len(met) == 48 and all(abs(n - 250) < 5 * 250**0.5 for n in met.values())


def test_matrix_is_exact_and_even():
    parts, cells = [50, 0, 30, 20], [25, 25, 25, 25]
    total = np.zeros((4, 4))
    for seed in range(300):
        m = shuffle.draw_matrix(parts, cells, seed)
        assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == cells
        total += m
    assert np.allclose(total / 300, np.outer(parts, cells) / 100, atol=0.6)


# -- leaks ------------------------------------------------------------------------------------------


def brute_distance(pattern, words):
    last = [0] * (len(words) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, w in enumerate(words, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != w)))
        last = row
    best = min(last)
    return best, last.index(best)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, text(rng, rng.randint(5, 40), 60)) for i in range(12)] + [(50, None), (51, ""), (52, "Only Two"), (0, None)]
    rows = []
    for d in range(60):
        words = text(rng, rng.randint(0, 120), 60).split()
        if d % 3:
            words[5:5] = [w if rng.random() > 0.12 else rng.choice(["x", "", "y z"]) for w in items[d % 12][1].upper().split()]
        rows.append((d, ", ".join(words)))
    rows += [(70, None), (71, ""), (72, "only, two!"), (72, "only, two!"), (None, items[3][1]), (73, f"{LONG} {items[2][1]} {LONG}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    want = Counter()
    for d, t in rows:
        words = leaks.words_of(t or "")
        for i, item in items:
            p = leaks.words_of(item or "")
            if p:
                best, end = brute_distance(p, words) if len(words) < 5000 else (0 if " ".join(p) in " ".join(words) else 99, " ".join(words).find(" ".join(p)))
                if len(words) >= 5000 and best == 0:
                    end = len(" ".join(words)[: end + len(" ".join(p))].split())
                if best <= int(0.2 * len(p)):
                    want[(d, i, best, end)] += 1
    got = rows_of(leaks.find_leaks(docs, bench))
    assert Counter((r["doc_id"], r["item_id"], r["distance"], r["end_word"]) for r in got) == want
    clean = leaks.drop_leaks(docs, bench).collect()
    assert Counter(r.doc_id for r in clean) == Counter(d for d, _ in rows) - Counter({d: sum(1 for x, _ in rows if x == d) for d, *_ in want})
    assert leaks.find_leaks(empty(spark), bench).count() == 0
    assert leaks.find_leaks(docs, empty(spark, "item_id bigint, text string")).count() == 0


# -- ids --------------------------------------------------------------------------------------------

BIG = 1 << 60


def test_large_ids_stay_whole_beside_nulls(spark):
    ids = [BIG + 1, BIG + 3, None, -BIG - 5]
    df = spark.createDataFrame([(d, f"some words of document {i} " * 5) for i, d in enumerate(ids)], "doc_id bigint, text string").coalesce(1)
    assert Counter(r["doc_id"] for r in rows_of(packing.pack_documents(df, BPE))) == Counter(ids)
    assert Counter(r["doc_id"] for r in rows_of(sequences.tokenise(df, WORDS))) == Counter(ids)
    items = spark.createDataFrame([(BIG + 7, "of document 1 some words of"), (None, "words of document 3 some")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in rows_of(leaks.find_leaks(df, items))}
    assert (BIG + 3, BIG + 7) in found and (-BIG - 5, None) in found and {d for d, _ in found} == set(ids)
    pages = spark.createDataFrame([(d, "http://a", "same") for d in ids] + [(BIG + 9, "u", "other")], PAGES).coalesce(1)
    out = {r["page_id"]: r["refers_to"] for r in rows_of(warc.archive_pages(pages))}
    assert out == {BIG + 1: BIG + 3, BIG + 3: None, None: BIG + 3, -BIG - 5: BIG + 3, BIG + 9: None}


def test_ids_may_be_names(spark):
    names = ["b", "a/<x> é", "none", "", None]
    df = spark.createDataFrame([(d, f"some words of document {i} " * 5) for i, d in enumerate(names)], "doc_id string, text string")
    assert Counter(r["doc_id"] for r in rows_of(packing.pack_documents(df, BPE))) == Counter(names)
    assert [r["doc_id"] for r in sorted(rows_of(sequences.tokenise(df, WORDS)), key=lambda r: r["start"])] == [None, "", "a/<x> é", "b", "none"]
    items = spark.createDataFrame([("i", "document")], "item_id string, text string")
    assert Counter((r["doc_id"], r["item_id"]) for r in rows_of(leaks.find_leaks(df, items))) == Counter((n, "i") for n in names)
    out = {r["page_id"]: r["refers_to"] for r in rows_of(warc.archive_pages(spark.createDataFrame([(d, None, "same") for d in names], "page_id string, url string, html string")))}
    assert out == {"b": "none", "a/<x> é": "none", "none": None, "": "none", None: "none"}


# -- urls -------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "com", "/fr/x"), ("block", "a.com", "/q"), ("allow", "a.com", "/q")]
    pages = ["http://WWW.Example.ORG/en/12?x", "https://example.org/es/", "http://notexample.org/es/", "http://x.com/fr/x#y", "http://com/de/", "nothing", None, "", "://", "http://a.com/q/1", "http://org", "x://a.b.c.d.e.f.g.com/de/z", "http://a.com:80/de/", "http://org/\n"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(pages)] + [(0, pages[0], "clash")], "page_id bigint, url string, rule string")
    table = spark.createDataFrame(rules, "action string, host string, path string")
    for r in rows_of(urls.judge_urls(df, table)):
        u = pages[r["page_id"]]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[2], best[3]), u
    assert urls.judge_urls(df, table.limit(0)).where("verdict = 'allow'").count() == len(pages) + 1
    assert urls.judge_urls(df.limit(0), table).count() == 0


# -- conversations ----------------------------------------------------------------------------------


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "How do I sort a list in place? I tried sorted already."),
        (1, 1, "assistant", "Use the sort method of the list."),
        (1, 2, "user", "> Use the sort\n> method of the list.\nThat works, thanks a lot."),
        (1, 3, "user", "On Monday Ann wrote:\n>> How do I sort a list in place?\n> Use the sort method of the list.\n\nBoth are fine answers."),
        (1, 4, None, "> How do I sort a list in place?\nAnother idea here."),
        (2, 0, "user", "How do I sort a list in place?"),
        (2, None, "user", None),
        (None, 5, "user", "> never said by anyone here\nx"),
        (2, 7, "user", "a > b is no quote"),
        (2, 7, "user", "a > b is no quote"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {(r["conv_id"], r["turn"], r["position"]): r for r in rows_of(quotes.link_quotes(df))}
    get = lambda *k: (out[k]["reply_to"], out[k]["linked"], out[k]["body"])
    assert get(1, 0, 0) == (None, False, rows[0][3])
    assert get(1, 2, 2) == (1, True, "That works, thanks a lot.")
    assert get(1, 3, 3) == (1, True, "Both are fine answers.")
    assert get(1, 4, 4) == (0, True, "Another idea here.")
    assert get(2, None, 0) == (None, False, "") and get(2, 0, 1)[0] is None
    assert get(2, 7, 2)[0] == 0 and get(2, 7, 3)[0] == 0 and get(None, 5, 0)[2] == "x"
    whole = {r["conv_id"]: r for r in rows_of(quotes.conversations(df))}
    assert whole[1]["n_messages"] == 5 and whole[1]["n_linked"] == 3 and whole[1]["replies"] == [-1, 0, 1, 1, 0]
    assert ">" not in whole[1]["text"].replace("|>", "")
    many = spark.createDataFrame([(9, i, "user", f"message {i}") for i in range(3000)], df.schema)
    got = sorted(rows_of(quotes.conversations(many)), key=lambda r: r["part"])
    assert [t for r in got for t in r["turns"]] == list(range(3000)) and max(r["n_messages"] for r in got) == 256
    assert quotes.conversations(df.limit(0)).count() == 0


def brute_replies(messages):
    """``{turn: (reply_to, linked)}`` of one conversation, by comparing sentences as text."""
    import re

    def sentences(passage):
        return [x for x in (re.findall(r"\w+", part.lower()) for part in re.split(r"(?<=[.!?])\s+", passage)) if x]

    said = {}
    for turn, text in messages:
        own = "\n".join(line for line in text.split("\n") if not line.startswith(">"))
        for paragraph in own.split("\n\n"):
            for words in sentences(paragraph.replace("\n", " ")):
                said.setdefault(tuple(words), turn)
    out = {}
    for at, (turn, text) in enumerate(messages):
        votes = defaultdict(Counter)
        quoted = [(len(m[1].replace(" ", "")), m[2]) for m in (re.match(r"((?:> ?)+)(.*)", line) for line in text.split("\n")) if m]
        for level, passage in quoted:
            for words in {tuple(w) for w in sentences(passage) if len(w) >= 3}:
                first = said.get(words)
                if first is not None and first < turn:
                    votes[level][first] += 1
        if votes:
            best = votes[min(votes)]
            out[turn] = (max(best, key=lambda t: (best[t], t)), True)
        else:
            out[turn] = (messages[at - 1][0] if at else None, False)
    return out


def test_quotation_linking_against_brute_force(spark):
    rng, rows, want = random.Random(15), [], {}
    for conv in range(12):
        messages, own = [], []
        for turn in range(rng.randint(1, 25)):
            mine = [f"Word{rng.randint(0, 40)} said {text(rng, 4, 30)}." for _ in range(rng.randint(1, 4))]
            lines, used = [], set()
            for level in range(rng.choice([0, 0, 1, 2, 3]) if own else 0, 0, -1):
                s = rng.choice(rng.choice(own))
                if s not in used:
                    lines.append(rng.choice(["> ", ">"]) * level + (s.upper() if rng.random() < 0.3 else s))
                    used.add(s)
            body = "\n".join([*lines, " ".join(mine)])
            messages.append((turn * 3, body))
            own.append(mine)
        rows += [(conv, t, "user", b) for t, b in messages]
        want |= {(conv, t): r for t, r in brute_replies(messages).items()}
    got = rows_of(quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)))
    assert {(r["conv_id"], r["turn"]): (r["reply_to"], r["linked"]) for r in got} == want
    assert sum(linked for _, linked in want.values()) > 30
    assert all(not line.startswith(">") for r in got for line in r["body"].split("\n"))


# -- host rules -------------------------------------------------------------------------------------


def test_host_rules(spark, docs):
    got = rows_of(hosts.with_verdicts(common.materialise(hosts.measured(docs.withColumn("measures", F.lit("clash"))), "t")))
    assert {r["measures"] for r in got} == {"clash"}
    import re

    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    for r in got:
        assert tuple(r[m] for m in hosts.MEASURES) == brute(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])
    assert len(got) == docs.count()
    assert hosts.keep_good(empty(spark)).count() == 0


def test_rejected_hosts(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, 80), "", "good", 0) for i in range(100)] + [(1000 + i, "junk", "", "bad", 0) for i in range(100)] + [(2000, text(rng, 80), "", "bad", 0), (2001, text(rng, 80), "", None, 0)]
    kept = {r["doc_id"] for r in rows_of(hosts.keep_good(spark.createDataFrame(rows, DOCS)))}
    assert kept == {*range(100), 2001}


def test_pipeline_matches_brute_force(spark, docs):
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(docs.where("doc_id = 20").first().text.split()[5:40]))], "item_id bigint, text string").write.mode("overwrite").parquet(d := common.new_path(spark, "sf") + "/benchmark.parquet")
    sf, out = d.rsplit("/", 1)[0], docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, common.materialise(stage(spark, out, sf), "stage")
        if name == "quality rules":
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in before.collect() if len((r.text or "").split()) >= 50 and 2 * hosts.measure(r.text)[4] <= hosts.measure(r.text)[0])
        elif name == "benchmark decontamination":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in out.collect()} == {20}
        if name != "best-fit packing":
            assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in before.collect()}


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] == list(plans.queries()) and "pipeline" in names
