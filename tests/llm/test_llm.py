"""Each operator against a brute-force version or a round trip, with the odd cases of its contract."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depinfer.llm import op1_token_orc, op2_decontaminate, op3_licenses, op4_extract, op5_suffix_dedup, op6_warc, op7_packing, op8_quality, op9_minhash, op10_topk, queries, tokens
from depinfer.llm.common import work_dir
from depinfer.llm.components import connected_components

from . import brute

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
ODD = [(50, None), (51, ""), (52, " \n "), (None, "a b c"), (53, "x"), (53, "x"), (54, "Äé 中 👍 \t\r\n  two  spaces <|endoftext|>"), (55, "word " * 3000)]


def docs(spark, rows):
    """With columns whose names clash with those of results."""
    return spark.createDataFrame([(i, x, 7, "z") for i, x in rows], DOCS + ", start int, n_chars string")


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def whole(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return t


def encoded(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


# Tokens


def test_encoder_equals_library_on_odd_texts(tokenizer):
    rnd = random.Random(1)
    parts = ["a", "b", "é", " ", " ", "\n", "\t", ".", ",", "'s", "'", "1", "　", "\xa0", "#", "<|endoftext|>", "\x1c", "中", "👍", "\r\n", "\x85", "Word"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(5000)]
    with open(tokens.default_tokenizer(), encoding="utf-8") as f:
        enc = tokens.Encoder(f.read())
    ends, ids = enc.encode(pa.array(texts), 9)
    want = [[*e.ids, 9] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_op1_round_trip_and_file_layout(spark, tokenizer, tmp_path):
    rows = [*ODD, *((i, f"text {i} of some words.") for i in range(40, 0, -1))]
    path = f"file://{tmp_path}/orc"
    op1_token_orc.write_token_orc(docs(spark, rows), path, stripe_bytes=1 << 16)
    got = op1_token_orc.token_digests(op1_token_orc.read_token_orc(spark, path)).collect()
    got = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    at = 0
    left = sorted((i if i is not None else -1, zlib.crc32(encoded(tokenizer, x, 2)), len(encoded(tokenizer, x, 2))) for i, x in rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == left
    from pyarrow import orc

    files = list((tmp_path / "orc").glob("*.orc"))
    assert all(orc.ORCFile(f).row_index_stride == 10_000 for f in files)
    java, conf = spark._jvm.org.apache.orc, spark._jsc.hadoopConfiguration()
    for f in files:
        reader = java.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(f)), java.OrcFile.readerOptions(conf))
        assert list(reader.getSchema().getFieldNames())[0] == "doc_id"
        for stripe in reader.getStripes():
            streams = {(x.getKind().toString(), x.getColumn()) for x in reader.rows().readStripeFooter(stripe).getStreamsList()}
            # Column 1 is doc_id; the ids are the element column of the list.
            assert {("BLOOM_FILTER_UTF8", 1), ("ROW_INDEX", 1), ("ROW_INDEX", 6), ("DATA", 6)} <= streams and ("BLOOM_FILTER_UTF8", 2) not in streams
    # A point look-up prunes by the indexes: the plan pushes the filter into the files.
    assert "EqualTo(doc_id,54)" in op1_token_orc.read_token_orc(spark, path).filter("doc_id = 54")._jdf.queryExecution().toString()


def test_op1_empty(spark, tmp_path):
    op1_token_orc.write_token_orc(docs(spark, []), f"file://{tmp_path}/orc")
    assert op1_token_orc.read_token_orc(spark, f"file://{tmp_path}/orc").count() == 0


def test_op7_pieces_and_sequences(spark, tokenizer):
    rows = [*ODD, *((i + 1000, x) for i, x in table(spark, "documents").select("doc_id", "text").collect())]
    got = op7_packing.pack(docs(spark, rows), keep_ids=True).toPandas()
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in got.itertuples())
    assert got.length.sum() == sum(len(encoded(tokenizer, x, 1)) for _, x in rows)
    by_id = {i: encoded(tokenizer, x, 1) for i, x in rows if i not in (None, 53)}
    for i, group in got.sort_values("start").groupby("doc_id"):
        if i in by_id:
            at = 0
            for p in group.itertuples():
                assert p.start == at and p.doc_tokens == len(by_id[i]) and p.ids_crc32 == zlib.crc32(by_id[i][at : at + p.length])
                at += p.length
            assert at == len(by_id[i])
    placed = got.sort_values(["sequence_id", "offset"])
    assert ((placed.groupby("sequence_id").length.cumsum() - placed.length) == placed.offset).all()
    totals = placed.groupby("sequence_id").length.sum()
    assert totals.max() <= 2048 and len(totals) <= 1.02 * totals.sum() / 2048 + 1
    assert op7_packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 7, 300, 5000])
def test_patterns_cover_the_demand(n):
    sizes = np.random.default_rng(n).integers(1, 129, n)
    demand = {int(s): int(k) for s, k in zip(*np.unique(sizes, return_counts=True))}
    plans = op7_packing.solve_patterns(demand, 128)
    placed = {}
    for pattern, times in plans:
        assert sum(s * c for s, c in pattern.items()) <= 128
        for s, c in pattern.items():
            placed[s] = placed.get(s, 0) + c * times
    assert placed == demand
    assert sum(t for _, t in plans) <= -(-sizes.sum() // 128) * 1.03 + 2


def test_the_priced_patterns_hold_the_documents(spark):
    """Over a table's own lengths: columns come from pricing, the program ends near its bound, and little is left to first-fit."""
    pieces = op7_packing.pack(table(spark, "documents")).toPandas()
    demand = {int(s): int(k) for s, k in zip(*np.unique(-(-pieces.length.to_numpy() // 8), return_counts=True))}
    report = {}
    plans = op7_packing.solve_patterns(demand, 256, report=report)
    assert report["pricings"] > 3 and report["pivots"] > 100 and report["pieces"] > 5 * report["left"]
    assert report["bound"] <= report["value"] <= 1.001 * report["bound"]
    assert sum(t for _, t in plans) == pieces.sequence_id.nunique() <= report["bound"] + 3


def test_program_against_the_exact_one():
    """All patterns listed: no multipliers of the classes (any feasible duals) may prove a higher bound than the program's value."""
    rnd = random.Random(11)
    for _ in range(8):
        capacity = 12
        sizes = np.array(sorted(rnd.sample(range(1, 13), 5), reverse=True))
        need = np.array([rnd.randrange(1, 40) for _ in sizes], float)
        program = op7_packing.PatternProgram(sizes, need, capacity)
        program.solve(0.0, 500, 5000)
        every = [()]
        for s in sizes:
            every = [p + (k,) for p in every for k in range(capacity // s + 1) if int(np.dot(p + (k,), sizes[: len(p) + 1])) <= capacity]
        duals = program.inverse.sum(axis=0)
        # Optimal by duality: the patterns cover the need, and the duals that give the same value are feasible for all patterns.
        assert np.allclose(program.columns @ program.times, need)
        assert need @ duals == pytest.approx(program.value)
        assert max(np.dot(p, duals) for p in every) <= 1 + 1e-6 or program.value == pytest.approx(program.bound)


# Texts


def test_op2_finds_reparameterised_items(spark):
    item = "Well, Tom has 12 apples and gives 5 kg of them to Ann, so that Tom keeps 7 apples while Ann now counts 5 more than before."
    other = "So it goes: Bob has 30 apples and gives 9 lbs of them to Eve, so that Bob keeps 21 apples while Eve now counts 9 more than before."
    broken = "So it goes: Bob has 30 apples and gives 9 lbs of them to Eve, so that Jim keeps 21 apples while Kim now counts 8 more than before."
    rows = [(1, "First. " + item + " Then more."), (2, other), (3, broken), (4, None), (5, ""), (6, "tom has apples"), (None, "x " + item), (2, "another text"), (1, "First. " + item + " Then more.")]
    items = spark.createDataFrame([(1, item, "e"), (2, None, "e"), (3, "one two", "e"), (4, "so it goes bob", "e"), (5, "", "e")], "item_id bigint, text string, doc_id string")
    found = op2_decontaminate.find_leaks(docs(spark, rows), items)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == [(1, 1), (2, 1), (None, 1)]
    kept = op2_decontaminate.drop_leaks(docs(spark, rows), items)
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(2, "another text"), (3, broken), (6, "tom has apples")]
    assert kept.columns == docs(spark, rows).columns
    assert op2_decontaminate.find_leaks(docs(spark, []), items).count() == 0 and op2_decontaminate.find_leaks(docs(spark, rows), items.limit(0)).count() == 0
    assert op2_decontaminate.find_leaks(docs(spark, rows), items, broadcast_windows=0).count() == 3


def test_op2_names_that_open_sentences(spark):
    maria = "Maria has 5 red apples in her basket. Maria gives 2 of them to Tom. How many apples are left?"
    weng = "Weng earns 12 dollars an hour for babysitting. Weng worked 50 minutes. Weng then paid 3 dollars. How much did Weng keep?"
    items = spark.createDataFrame([(1, maria), (2, weng), (3, "Is this a good idea?"), (4, "Kim sold 5 red hats."), (5, "so it is")], "item_id bigint, text string")
    rows = [
        (1, maria.replace("Maria", "Olga").replace("5", "9").replace("2", "4").replace("Tom", "Ben")),
        (2, weng.replace("Weng", "Lars").replace("12", "20").replace("50", "35").replace("3", "8")),
        (3, "He said:\n\"Olga has 9 red apples in her basket. Olga gives 4 of them to Ben. How many apples are left?\""),
        (4, "Olga has 9 red apples in her basket. Jim gives 4 of them to Eve. Some many apples are left? Kim has none."),
        (5, "Was this a good idea?"),
        (6, "Lea sold 7 red hats."),
        (7, "what this is a good idea"),
    ]
    found = op2_decontaminate.find_leaks(docs(spark, rows), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 2), (3, 1), (6, 4)]


NAMES = "Maria Olga Tom Ben Weng Lars Priya Chidi Ana Karl Yuki Omar Lea Finn Zoe Ivan".split()
STORIES = [
    "{a} has {x} red apples and {b} has {y} more than {a} . How many apples does {b} have when {a} gives {x} of them away ?",
    "A train leaves for the coast with {x} people on board , and {y} minutes later {a} sees it pass . {b} counts {x} cars and asks {a} how fast it was .",
    "{a} and {b} paint a fence of {x} m in {y} hours . Then {b} works alone for {y} hours more , so how long is the part that {a} still has to paint ?",
    "In the shop of {a} a loaf costs {x} cents , and {b} buys {y} of them every week for the school . What does {b} pay {a} in a year ?",
    "{a} reads {x} pages a day while {b} reads {y} pages , but {b} began a week later than {a} . On which day have {a} and {b} read as many pages ?",
]


def told(rnd, story, a, b):
    x, y = rnd.sample(range(2, 900), 2)
    return story.format(a=a, b=b, x=x, y=y).replace(" .", ".").replace(" ?", "?").replace(" ,", ",")


def test_op2_recall_of_reparameterised_items_and_brute_force(spark):
    """Other names, numbers and units, and a word put in; stories told with two names mixed up are no leaks."""
    rnd = random.Random(8)
    items = [(k, told(rnd, s, *rnd.sample(NAMES, 2))) for k, s in enumerate(STORIES)]
    rows, leaked, mixed = [], set(), set()
    for i in range(100):
        k = i % 5
        text = told(rnd, STORIES[k], *rnd.sample(NAMES, 2))
        if i % 2:
            w = text.split(" ")
            w.insert(rnd.randrange(4, len(w) - 3), "really")
            text = " ".join(w)
        if i % 3 == 0:
            text = text.replace(" minutes", " seconds").replace(" m ", " km ").replace(" cents", " euros")
        rows.append((i, "Some words before it all. " + text + "\nAnd after."))
        leaked.add((i, k))
    for i in range(100, 120):
        text = told(rnd, STORIES[i % 5], "Maria", "Tom")
        for name in rnd.sample(NAMES[4:], 12):
            text = text.replace(rnd.choice(("Maria", "Tom")), name, 1)
        rows.append((i, text))
        mixed.add((i, i % 5))
    rows += [(200, items[1][1].replace("and", "and then", 1)), (201, "Ananas\nSo it goes\nthen"), (202, "we say so it goes"), (203, None), (204, "...")]
    items += [(10, "so it goes"), (11, None), (12, "..."), (13, "Kim sold 5 red hats."), (14, "Is this a good idea?")]
    rows += [(205, "Lea sold 7 red hats."), (206, "Was this a good idea?")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in op2_decontaminate.find_leaks(docs(spark, rows), table).collect()}
    assert found == brute.template_leaks(rows, items)
    assert len(found & leaked) >= 0.9 * len(leaked) and len(found & mixed) <= 0.2 * len(mixed)
    assert {(200, 1), (201, 10), (205, 13)} <= found and not {r for r in found if r[0] in (202, 203, 204, 206)}
    assert found == {(r.doc_id, r.item_id) for r in op2_decontaminate.find_leaks(docs(spark, rows), table, broadcast_windows=0).collect()}


def test_op2_query_against_brute_force(spark):
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op2_decontaminate"](spark, SMALL).collect()}
    pick = lambda name, key: [tuple(r) for r in table(spark, name).select(key, "text").collect()]
    assert got == brute.leaks(pick("documents", "doc_id"), pick("benchmark", "item_id")) == brute.template_leaks(pick("documents", "doc_id"), pick("benchmark", "item_id"))


def test_op3_query_and_odd_texts_against_brute_force(spark):
    rows = [*ODD, *((i + 1000, x) for i, x in table(spark, "documents").select("doc_id", "text").collect()), (900, "Intro.\n\n" + op3_licenses.TEMPLATES[3][1].replace(", ", ",\n") + "\n\nEnd."), (901, "licensed UNDER the apache license version 2.0")]
    stars = op3_licenses.TEMPLATES[3][1].replace(" ", " " + "*" * 60 + " ")
    rows += [(902, stars), (903, "a\n" + stars + "\nb"), (904, "x\n \n-\n" + stars + "\n\t\n...\n\ny"), (905, "Permission \n" * 40)]
    got = {(r.doc_id, r.license): r.dice for r in op3_licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == brute.licenses(rows, op3_licenses.TEMPLATES) and all((i, "MIT") in got for i in (900, 902, 903, 904))
    assert op3_licenses.scan_licenses(docs(spark, [])).count() == 0


def test_op3_units_on_the_bounds(spark):
    rows = [(1, "Code released under the MIT License here"), (2, "Our code released under the MIT License here")]
    templates = (("MIT", "Released under the MIT License."), ("ISC", "one two three four five six seven"))
    rows += [(3, "two three four five six"), (4, "two three four five")]
    got = {(r.doc_id, r.license): r.dice for r in op3_licenses.scan_licenses(docs(spark, rows), templates).collect()}
    assert got == {(1, "MIT"): 0.8, (3, "ISC"): 0.8} == brute.licenses(rows, templates)


PAGE = """<html><head><title>x</title></head><body><header class=site><a href=/>Home</a></header><nav>a b</nav><div id="cookie-notice">We use cookies.</div>
<main><h1>Title</h1><p>Hello &amp; <b>bold</b>
 text.<p>Second para. <script>if(a<b){}</script><ul><li>one<li>two</ul><div class="ad">Buy</div><blockquote>Quote</blockquote><form><label>Mail</label><input></form></main>
<section class="comments"><p>First! great article, I really liked this one very much, thank you so much for writing it.</p></section><aside>rel</aside><footer>&copy; me</footer></body></html>"""


def test_op4_page():
    assert op4_extract.extract_text(PAGE) == "Title\n\nHello & bold text.\n\nSecond para.\n\none\n\ntwo\n\nQuote"
    assert op4_extract.extract_text("") == "" and op4_extract.extract_text("<p>a<p>b") == "a\n\nb"
    assert op4_extract.extract_text("<div><p>" * 3000 + "deep text here." + "</div>" * 10) == "deep text here."


def test_op4_malformed_pages():
    extract = op4_extract.extract_text
    text = "A first paragraph that is long enough to be read, with a comma and a stop."
    # The head's end tag, and html, head and body themselves, are optional.
    assert extract(f"<html><head><title>t</title><style>p{{}}</style><body><p>{text}</p></body></html>") == text
    assert extract(f"<head><meta charset=x><script>1<2</script><link rel=a><p>{text}") == text
    # Quotes open a value only behind an equals sign.
    assert extract(f"<p title=don't>{text}</p><p>it's</p>") == f"{text}\n\nit's"
    assert extract(f'<p class="a"">{text}</p>') == text and extract(f'<p data-x="a > b" y=\'>\'>{text}</p>') == text
    assert extract(f"<p a=b/>{text}") == text and extract(f'<p a="never closed>{text}</p>') == text
    # What is never text does not end a block.
    assert extract(f"<p>{text} Some <svg><path/></svg>more<script>x</script> and<svg/> more.") == f"{text} Some more and more."
    for marks in ('class="layout content-with-sidebar"', 'class="post tag-news category-ads"', 'id="legal-news"', 'class="has-menu"'):
        assert extract(f"<div {marks}><h1>Title</h1><p>{text}</p></div>") == f"Title\n\n{text}"
        assert extract(f"<div {marks}><p>{text}</p><p>{text}</p></div>") == f"{text}\n\n{text}"
    assert extract(f"<form id=page class=form><main><p>{text}</p></main></form>") == text
    assert extract("<p>&lt;b&gt; &amp;amp; &#x41;&nbsp;&copy</p>") == "<b> &amp; A ©"


KEPT = [
    lambda w: (f"<h1>{w(4)}</h1>", 1), lambda w: (f"<h2>{w(2)}", 1), lambda w: (f"<p>{w(30)}.</p>", 1), lambda w: (f"<p>{w(12)}!", 1), lambda w: (f"<p title=it's>{w(3)}", 1),
    lambda w: (f"<ul><li>{w(2)}<li>{w(5)}</ul>", 2), lambda w: (f"<blockquote class=quote\">{w(9)}.</blockquote>", 1), lambda w: (f"<p>{w(8)} <a href=/x>{w(2)}</a> {w(20)}.", 1), lambda w: (f"<pre>{w(6)}</pre>", 1),
]
DROPPED = [
    lambda w: f"<nav><ul><li><a href=/a>{w(1)}</a><li><a href=/b>{w(1)}</a></ul></nav>", lambda w: f"<div class='site-header wide'>{w(3)}</div>", lambda w: f"<div id=cookie-notice><p>{w(20)}.</p></div>",
    lambda w: f"<div class=ad-slot>{w(15)}.</div>", lambda w: f"<aside><h3>{w(2)}</h3><p>{w(30)}.</p></aside>", lambda w: f"<footer><p>{w(12)}.</p></footer>", lambda w: f"<form action=/s><label>{w(2)}</label><input><button>{w(1)}</button></form>",
    lambda w: f"<section class=comments><article><p>{w(25)}.</p></article></section>", lambda w: f"<div class=sidebar-left><p>{w(25)}.</div>", lambda w: f"<script>{w(9)}</script><style>{w(2)}</style><!-- {w(3)} -->", lambda w: f"<div hidden><p>{w(20)}.</p></div>",
]


def test_op4_known_articles_and_what_the_cut_changes():
    """Pages put together from an article's blocks and from what surrounds them; the cut decides blocks that their own costs get wrong."""
    import html
    import re

    rnd = random.Random(44)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    shells = ["<article>{}</article>", "<main>{}</main>", '<div class="entry-content">{}</div>', '<div class="post tag-news">{}</div>', "<div><div>{}</div></div>"]
    right = changed = 0
    for n in range(200):
        shell = shells[n % 5]
        parts = [rnd.choice(KEPT)(words)[0] for _ in range(rnd.randrange(3, 9))] + [KEPT[2](words)[0]] * (n % 5 > 2)
        want = [html.unescape(re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", x))).strip() for part in parts for x in re.split(r"(?=<li)", part) if re.sub(r"<[^>]*>", "", x).strip()]
        around = [rnd.choice(DROPPED)(words) for _ in range(6)]
        head = rnd.choice(["<html><head><title>x</title><body>", "<head><title>x</title></head><body class=x>", ""])
        page = head + "".join(around[:3]) + shell.format("".join(parts)) + "".join(around[3:])
        got = op4_extract.extract_text(page).split("\n\n")
        right += got == want
        scores, edges = op4_extract.cut_problem(blocks := op4_extract.text_blocks(page))
        keep = op4_extract.minimum_cut([max(x, 0) for x in scores], [max(-x, 0) for x in scores], edges)
        changed += sum((scores[i] > 0) != keep[i] for i in range(len(blocks)))
    assert right >= 190 and changed > 200


def test_op4_pages_of_the_table(spark):
    """The article element's own text, read off with regular expressions."""
    import html
    import re

    changed = 0
    for r in table(spark, "pages").collect():
        article = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        plain = lambda x: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x)))).strip()
        want = [x for x in map(plain, re.split(r"<(?:h1|p|li|ul)>|</(?:h1|p|li|ul)>", article[1])) if x] if article else []
        assert op4_extract.extract_text(r.html or "") == "\n\n".join(want)
        blocks = op4_extract.text_blocks(r.html or "")
        if blocks:
            scores, edges = op4_extract.cut_problem(blocks)
            keep = op4_extract.minimum_cut([max(x, 0) for x in scores], [max(-x, 0) for x in scores], edges)
            changed += sum((scores[i] > 0) != keep[i] for i in range(len(blocks)))
    assert changed > 0


def test_op4_minimum_cut_against_all_labellings():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        a, b = ([rnd.randrange(12) for _ in range(n)] for _ in range(2))
        edges = [(i, j, rnd.randrange(6)) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        cost = lambda keep: sum(a[i] for i in range(n) if not keep[i]) + sum(b[i] for i in range(n) if keep[i]) + sum(c for i, j, c in edges if keep[i] != keep[j])
        assert cost(op4_extract.minimum_cut(a, b, edges)) == min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))


def test_op4_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (None, None, PAGE, 4)], "page_id bigint, url string, html string, n_chars int")
    got = op4_extract.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and all(len(r.text) == r.n_chars for r in got)
    assert op4_extract.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("length", [200, 41])
def test_op5_against_brute_force(spark, length):
    rnd = random.Random(5)
    prose = lambda n: " ".join(rnd.choice(["the", "áñ", "over", "tion", "x"]) + str(rnd.randrange(400)) for _ in range(n))
    base = [prose(60) for _ in range(4)]
    rows = [(i, prose(rnd.randrange(60)) + rnd.choice(base)[rnd.randrange(100) :] + prose(20)) for i in range(40)]
    rows += [*ODD, (60, "ab" * 500), (60, "ab" * 500), (61, rows[3][1]), (62, rows[3][1][:230]), (63, "z" * 205), (64, prose(9000) + base[1]), (None, base[0])]
    assert whole(op5_suffix_dedup.repeat_digests(docs(spark, rows), length)) == brute.repeats(rows, length)


def test_op5_query_and_stage(spark):
    rows = [tuple(r) for r in table(spark, "documents").select("doc_id", "text").collect()]
    want = brute.repeats(rows, 200)
    assert whole(queries.queries()["op5_suffix_dedup"](spark, SMALL)) == want
    kept = op5_suffix_dedup.remove_repeats(table(spark, "documents"))
    left = {r[0]: r[1] - r[2] for r in want}
    # A character that a cut splits goes as a whole.
    assert all(left[r.doc_id] - 6 * 4 <= len(r.text.encode()) <= left[r.doc_id] and r.n_chars == len(r.text) for r in kept.collect())
    assert op5_suffix_dedup.repeat_digests(docs(spark, [])).count() == 0


def test_op5_stage_keeps_columns_of_any_name(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(1, long, "p", 5, 1, 2), (1, "Ä " + long + " end", "q", 6, 1, 2), (2, None, "r", 7, 1, 2), (3, "short", "s", 8, 1, 2)], "doc_id int, text string, parts string, key int, found int, n_chars int")
    kept = op5_suffix_dedup.remove_repeats(rows)
    assert kept.schema == rows.schema
    assert sorted(map(tuple, kept.collect())) == [(1, "", "p", 5, 1, 0), (1, "Ä  end", "q", 6, 1, 6), (2, None, "r", 7, 1, 2), (3, "short", "s", 8, 1, 5)]


def test_op9_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice((30, 80, 200)))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i + 100, " ".join(w)))
    rows += [*ODD, (1002, "a b c"), (1003, "A  B\tc"), (1004, "a b c d e"), (1006, rows[0][1].upper()), (None, rows[1][1]), (3, rows[2][1] + " zz")]
    assert whole(op9_minhash.near_duplicates(docs(spark, rows))) == brute.near_duplicates(rows)
    kept = op9_minhash.deduplicate(docs(spark, rows))
    components = {x[2] for x in brute.near_duplicates(rows) if x[1]}
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect() if (r.text or "").strip()} == components
    assert op9_minhash.near_duplicates(docs(spark, [])).count() == 0


def test_pipeline_links_near_duplicates_from_080(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]
    # 100 shingles each; n changed words at the end leave 100 - n shared: 90/110 = 0.818 and 87/113 = 0.770.
    rows = [(1, " ".join(words)), (2, " ".join(words[:-10] + [f"x{i}" for i in range(10)])), (3, " ".join([f"v{i}" for i in range(13)] + words[13:]))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(spark, rows), SMALL).collect()) == [1, 3]
    assert op9_minhash.deduplicate(docs(spark, rows)).count() == 3


def test_late_links_are_found_in_small_blocks(spark, monkeypatch):
    """A chain in which most members are too far from the centre."""
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join([f"q{i}_{j}" for j in range(0)] + words[i : i + 120])) for i in range(40)]
    monkeypatch.setattr(op9_minhash, "BLOCK", 4)
    assert whole(op9_minhash.near_duplicates(docs(spark, rows))) == brute.near_duplicates(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (None, 3), (101, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_op8_held_out_accuracy_and_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()["op8_quality"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    sure = held[(held.predicted == held.quality) & ((held.score > 0.95) | (held.score < 0.05))]
    got_good = spark.createDataFrame(sure[["doc_id", "quality"]])
    assert len(got) == 1000 and ((held.predicted == held.quality).mean() > 0.95) and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.itertuples())
    rows = docs(spark, ODD)
    none = spark.createDataFrame([(50, None, 1)], "doc_id bigint, quality int, text int")
    assert [r.score for r in op8_quality.predict_quality(rows, none).collect()] == [0.5] * len(ODD)
    few = spark.createDataFrame([(51, 1, 1), (55, 0, 1), (54, 1, 0), (53, 0, 0), (999, 1, 0), (51, 1, 1)], "doc_id bigint, quality int, text int")
    assert op8_quality.predict_quality(rows, few).count() == len(ODD)
    assert op8_quality.keep_good(rows, few).columns == rows.columns
    good, bad = ([r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(got_good, "doc_id").filter(f"quality = {q}").orderBy("doc_id").limit(3).collect()] for q in (1, 0))
    # Rows that share an id are kept or dropped by their own text.
    mixed = docs(spark, [(7, good[0]), (7, bad[0]), (None, good[1]), (None, bad[1]), (8, good[0]), (7, bad[0])])
    again = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumns({"start": F.lit(0), "n_chars": F.lit("z")}).unionByName(mixed.withColumn("doc_id", F.col("doc_id") + 10**6))
    kept = {(r.doc_id, r.text) for r in op8_quality.keep_good(again, spark.read.parquet(f"{sf}/labels.parquet")).filter("start = 7").collect()}
    assert kept == {(10**6 + 7, good[0]), (None, good[1]), (10**6 + 8, good[0])}
    assert op8_quality.predict_quality(docs(spark, []), few).count() == 0


def test_isotonic():
    assert op8_quality.isotonic([1, 2, 3, 4], [1, 1, 1, 1], [0, 1, 0, 1]) == ([1, 2.5, 4], [0, 0.5, 1])


# Pages and vectors


def test_op6_transactions(spark):
    x = "é" * 600
    rows = [(1, "http://a/b c\n", x, 1), (2, None, x, 2), (9, "http://[bad", x, 3), (9, "u", x, 3), (3, "q", None, 1), (5, "s", "kurz", 1), (6, "s", "kurz", 1), (None, "z", x, 1), (None, "z", "\r\n\r\nWARC/1.1\r\n", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, type int")
    got = op6_warc.assemble_transactions(op6_warc.read_warc(op6_warc.write_warc(pages, work_dir(spark, "warc"), file_bytes=2000))).collect()
    found = sorted(((r.metadata.get("page-id"), r.response.type, r.response.payload_bytes, r.metadata.get("refers-to-page-id")) for r in got), key=str)
    assert found == sorted([("1", "revisit", 1200, "9"), ("2", "revisit", 1200, "9"), ("9", "response", 1200, None), ("9", "response", 1200, None), ("3", "response", 0, None), ("5", "response", 4, None), ("6", "response", 4, None), (None, "revisit", 1200, "9"), (None, "response", 14, None)], key=str)
    assert all(r.request.request_line.startswith("GET ") for r in got)
    assert {bytes(r.response.payload) for r in got if r.response.type == "response"} == {(y or "").encode() for y in (x, None, "kurz", "\r\n\r\nWARC/1.1\r\n")}
    assert op6_warc.assemble_transactions(op6_warc.read_warc(op6_warc.write_warc(pages.limit(0), work_dir(spark, "warc")))).count() == 0


@pytest.mark.parametrize("block", [65_536, 37])
def test_op10_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=9) * (0.1 if i % 3 else 3)]) for i in range(120)]
    rows += [(240, rows[0][1])] * 3 + [(i, rows[3][1]) for i in range(300, 340)] + [(None, rows[0][1]), (400, None), (420, [1.0, None] + [0.0] * 7), (440, [float("nan")] * 9), (460, [float("inf")] * 9)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    assert whole(op10_topk.top_k(df, block_rows=block)) == brute.top_k(rows)
    assert op10_topk.top_k(df.limit(0)).count() == 0
    # Finite components of any size: exact, and at the end of the range beyond it.
    rows += [(500, [1e30] + [0.0] * 8), (501, [-1e300] * 9), (502, [2.0**21] * 9), (503, [1e308, -1e308] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    got = op10_topk.top_k(df, block_rows=block).collect()
    assert whole(spark.createDataFrame(got)) == brute.top_k(rows)
    assert {r.score for r in got if r.query_id == 500 and r.vec_id == 501} <= {-(2**63)} and max(r.score for r in got) == 2**63 - 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    df = queries.queries()[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    columns, names = sorted(df.columns), list(rel.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in rel.fetchall()), key=str)


def test_pipeline(spark):
    import corpus_pipeline

    at = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = at.columns, at.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, SMALL), "test")
        assert at.columns == columns and 0 < at.count() <= n
        n = at.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SMALL)
    assert packed.select("doc_id").distinct().count() == n
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()


def test_pipeline_gives_ids_and_removes_its_work(spark, tokenizer):
    import os

    import corpus_pipeline
    from depinfer.functions.storage import work_folder

    folder = work_folder(spark).removeprefix("file://")
    tables = {t.name for t in spark.catalog.listTables()}
    before = {x for x in os.listdir(folder) if x.startswith(("op", "pipeline"))}
    out = corpus_pipeline.run(spark, SMALL)
    left = {x for x in os.listdir(folder) if x.startswith(("op", "pipeline"))} - before
    assert len(left) == 1 and out.work_path.endswith(left.pop())
    for r in out.limit(50).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and (r.start + r.length < r.doc_tokens or ids[-1] == 1)
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_stages_with_odd_rows(spark):
    """Null and empty texts, null and repeated ids, equal rows, very long texts, empty tables and clashing columns through every stage."""
    import corpus_pipeline

    good = [r.text for r in table(spark, "documents").join(table(spark, "labels").filter("quality = 1"), "doc_id").orderBy("doc_id").select("text").limit(12).collect()]
    rows = [(10**6 + i, x) for i, x in enumerate(good)] + [(None, good[0] + " and more"), (10**6, good[0]), (10**6, good[0]), (10**6 + 1, None), (None, None), (5, ""), (6, " \n"), (7, " ".join(good) * 20), (8, "x")]
    names = "parts key row words windows score n_tokens said rank centre start length __at".split()
    odd = spark.createDataFrame([(i, x, "xx", *range(len(names))) for i, x in rows], "doc_id bigint, text string, lang string, " + ", ".join(f"{c} int" for c in names))
    texts = lambda df: sorted(map(str, (r.text for r in df.collect())))
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.materialize(stage(spark, odd, SMALL), "odd")
        none = stage(spark, odd.limit(0), SMALL)
        assert none.count() == 0
        if name == "packing":
            assert got.filter("start = 0").count() == len(rows)
            continue
        assert got.schema.names == odd.schema.names == none.schema.names
        if name == "quality":
            # Equal texts get equal scores, whatever their ids.
            assert {t for t in texts(got)}.isdisjoint(set(texts(odd.exceptAll(got))))
        elif name == "near_duplicates":
            kept = texts(got)
            assert kept.count(good[0]) == 1 and kept.count("None") == 2 and "" in kept and " \n" in kept and got.filter(f"text = '{good[0][:0]}x'").count() == 1
        elif name == "repeated_strings":
            assert got.count() == len(rows) and got.filter("text is null").count() == 2 and got.filter(f"doc_id = 7 and text = ''").count() == 1
        else:
            assert got.filter("text is null").count() == 2 and got.count() <= len(rows)
