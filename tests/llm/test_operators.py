"""The training-data operators against brute force, round trips and the edge cases they define."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.llm import chat, extract, jaccard, neural_lm, packing, pieces, pivots, quality, repeats, warc
from sparrowgrid.llm.common import components, settle

DOCS = "doc_id long, text string"


@pytest.fixture(autouse=True)
def _settled(spark):
    settle(spark)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# 1. pieces


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_encoding_is_the_librarys(model):
    table = pieces.PrefixTable(model)
    rng = random.Random(4)
    alphabet = list(" \t\nabcdethion▁éü日本😀\x00\xa0") + ["<0x0A>", "</s>", "tion", " the"]
    texts = ["", " ", "a", "x" * 5000, "aaaa" * 2000] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    assert [table.encode(t) for t in texts] == table.library.encode(texts)


def test_encode_frame(spark, model):
    df = spark.createDataFrame([(1, "Hello world\n", "x"), (1, "Hello world\n", "x"), (2, None, "y"), (3, "", None)], DOCS + ", ids string")
    rows = pieces.encode_decode(df, model).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == ["Hello world\n", "Hello world\n", "", ""]
    assert rows[0].ids == rows[1].ids and rows[2].ids == []
    assert pieces.encode_decode(df.limit(0), model).count() == 0


# 2. jaccard


def brute_groups(rows, n, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, set()).update(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)) if w)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and sets[x] and sets[y]:
                k = len(sets[x] & sets[y])
                if den * k >= num * (len(sets[x]) + len(sets[y]) - k):
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_jaccard_groups(spark, n, num):
    rng, rows = random.Random(5), []
    for size in (9, 12, 20, 60, 150, 300):
        base = words(size, size)
        for _ in range(16):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "a", "A  a", "a A", "a b c", None])]
    rows.append(rows[3])
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, DOCS), n=n, num=num, den=100).collect()
    want = brute_groups(rows, n, num, 100)
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = jaccard.jaccard_groups(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], DOCS)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, None), (2, 2)}


def test_divide_skip():
    rng, limit = np.random.default_rng(1), jaccard.Limit(8, 10)
    base = np.unique(rng.integers(0, 1000, 120)).astype(np.uint64)
    block = [np.unique(np.concatenate([rng.permutation(base)[k:], rng.integers(1000, 2000, k // 2).astype(np.uint64)])) for k in range(0, 60)]
    want = [i for i, s in enumerate(block) if 10 * len(np.intersect1d(s, base)) >= 8 * len(np.union1d(s, base))]
    assert jaccard.divide_skip(base, len(base), block, [len(s) for s in block], limit) == want and 0 < len(want) < 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 99), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[99] == got[50] == 50


# 3. repeats


def brute_repeats(docs, length):
    first, out = {}, {}
    for i, x in sorted(docs):
        for j in range(len(x) - length + 1):
            first.setdefault(x[j : j + length], i)
    for i, x in docs:
        cut = np.zeros(len(x), bool)
        for j in range(len(x) - length + 1):
            if first[x[j : j + length]] < i:
                cut[j : j + length] = True
        out[i] = (len(x), int(cut.sum()), int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~cut])).hexdigest())
    return out


def test_repeats(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(90))) for _ in range(14)] + ["ha " * 60]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(7)))) for i in range(120)]
    rows += [(200, None), (201, ""), rows[5]]
    got = repeats.digests(repeats.remove_repeats(spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")))).collect()
    want = brute_repeats([(i, (t or "").encode()) for i, t in rows], 50)
    assert len(got) == len(rows) and [r for r in got if tuple(r)[1:] != want[r.doc_id]] == []
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_interval_tree_gives_all_occurrences():
    data = np.frombuffer(b"xabcabcy|zabcabcw|qabcabcr", np.uint8)
    starts, sizes, docs = np.array([0, 9, 18]), np.array([8, 8, 8]), np.array([1, 2, 3])
    owner, offset, size = repeats.repeats(data, starts, sizes, docs, 4)
    assert sorted(zip(owner.tolist(), offset.tolist(), size.tolist(), strict=True)) == [(1, 1, 6), (2, 1, 6)]


def test_repeat_groups_hold_all_occurrences(spark):
    rng = random.Random(11)
    fill = lambda: "".join(rng.choice("abcdefghij ") for _ in range(70))
    passage = "this passage of more than sixty bytes stands in many of the documents"
    rows = [(i, fill() + passage + fill() if i % 2 else fill()) for i in range(12)]
    groups = repeats.repeat_groups(spark.createDataFrame(rows, DOCS)).collect()
    texts = dict(rows)
    by = {}
    for g in groups:
        by.setdefault(g.repeat, []).append(g)
    assert by
    for same in by.values():
        said = {texts[g.doc_id].encode()[g.start : g.start + g.size] for g in same}
        assert len(said) == 1 and len({g.doc_id for g in same}) > 1
    # every place of the passage is in a group
    assert {(g.doc_id) for g in groups} == {i for i in range(12) if i % 2}
    assert repeats.repeat_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_clean_documents_keeps_whole_characters(spark):
    shared = "é" * 40
    rows = [(1, shared + "a", 41), (2, "b" + shared + "c", 42), (3, None, None)]
    got = {r.doc_id: r for r in repeats.clean_documents(spark.createDataFrame(rows, DOCS + ", n_chars long")).collect()}
    assert got[1].text == shared + "a" and got[2].text == "bc" and got[2].n_chars == 2 and got[3].text is None


# 4. warc


def test_warc_round_trip(spark):
    rows = [(3, "u", "héllo"), (1, "v", "héllo"), (2, None, None), (5, "x", ""), (4, "big", "ab" * 100_000), (None, "n", "héllo"), (4, "big", "ab" * 100_000)]
    chunks = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk=999)
    assert chunks.agg(F.max(F.length("bytes"))).first()[0] <= 999
    got = sorted(map(tuple, warc.read(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(3, 6, digest("héllo"), "revisit", 1), (1, 6, digest("héllo"), "response", None), (2, 0, digest(""), "response", None), (5, 0, digest(""), "revisit", 2), (None, 6, digest("héllo"), "revisit", 1)]
    want += [(4, 200_000, digest("ab" * 100_000), "response", None)] * 2
    assert got == sorted(want, key=str)
    running = chunks.where("chunk > 0").groupBy("record").agg(F.max_by("running_sha1", "chunk").alias("d"))
    assert hashlib.sha1(("ab" * 100_000).encode()).hexdigest() in {r.d for r in running.collect()}
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_damaged_warc_is_an_error(spark):
    chunks = warc.write(spark.createDataFrame([(1, "u", "x" * 50)], "page_id long, url string, html string"), chunk=10)
    with pytest.raises(Exception, match="cut short"):
        warc.read(chunks.where("chunk <> 3")).collect()


# 5. chat


def test_chat_reads_back(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n### user: hi </turn>\n", "\\\\l\\h<#>", "", None, " a ", "\n"]
    rows = [(1, k, "assistant" if k % 2 else "us:er#", t) for k, t in enumerate(nasty)] + [(2, None, None, "x"), (2, 0, "assistant", "y"), (None, 0, "assistant", "z"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if k % 2 else "us:er#", t or "") for k, t in enumerate(nasty)]
    assert got[1].loss == "".join(t or "" for t in nasty[1::2]) and got[2].loss == "y" and got[3].loss == "samesame" and got[None].loss == "z"


def test_reply_trees(spark):
    rows = [("c", 1, None, 1.0), ("c", 2, 1, 5.0), ("c", 3, 1, 1.0), ("c", 4, 3, 9.0), ("c", 5, 2, 1.0), ("d", 1, 77, 0.0), ("e", 1, 2, 1.0), ("e", 2, 1, 1.0)]
    messages = spark.createDataFrame(rows, "conv string, msg long, parent long, score double")
    best = sorted(map(tuple, chat.paths(messages, 1).select("conv", "leaf", "msg").collect()))
    assert best == [("c", 4, 1), ("c", 4, 3), ("c", 4, 4), ("d", 1, 1)]
    every = chat.paths(messages, None).groupBy("conv", "leaf", "rank").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "msg"))), lambda x: x["msg"].cast("string")), ">").alias("p"))
    assert {tuple(r) for r in every.collect()} == {("c", 4, 1, "1>3>4"), ("c", 5, 2, "1>2>5"), ("d", 1, 1, "1")}


def test_chat_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, leaf string"
    long = [(1, k, "user" if k % 2 else "assistant", f"t{k}", "clash") for k in range(700)]
    out = chat.format_conversations(spark.createDataFrame(long, schema)).first()
    assert out.formatted.count("</turn>") == 700 and len(out.loss_spans) == 350
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


# 6. scoring


def test_model_is_normalised_and_learns():
    s = neural_lm.Settings(classes=3, dim=4, noise=4, batch=64, rate=0.2)
    rng = np.random.default_rng(0)
    tokens = np.tile([0, 1, 2, 3, 4, 5], 4000).astype(np.int32)
    begins = np.zeros(len(tokens), bool)
    begins[::60] = True
    model = neural_lm.Model(np.array([4000, 4000, 4000, 4000, 4000, 3999]), 3, s)
    assert len(model.edges) == 4 and not model.single[:3].all()
    before = model.log_probs(tokens, begins).mean()
    touched = {name: np.zeros(len(x), np.int64) for name, x in model.p.items()}
    for _ in range(3):
        model.train(tokens, begins, rng, touched)
    assert model.log_probs(tokens, begins).mean() > before + 0.5
    each = [np.exp(model.log_probs(np.array([0, 1, w], np.int32), np.array([True, False, False]))[2]) for w in range(7)]
    assert abs(sum(each) - 1) < 1e-4
    copy = neural_lm.Model(np.array([4000, 4000, 4000, 4000, 4000, 3999]), 3, s)
    numbers, weights, values = model.rows(touched)
    copy.put(numbers, values)
    assert (weights > 0).all() and np.allclose(copy.log_probs(tokens, begins), model.log_probs(tokens, begins))


def test_scores_ignore_partitions_and_beat_the_unigram(spark):
    # texts in which each word tells the next
    rng, rows = random.Random(8), []
    for i in range(400):
        at, said = rng.randrange(60), []
        for _ in range(60):
            said.append(f"w{at}")
            at = (at * 7 + rng.choice([1, 1, 1, 2])) % 60
        rows.append((i, " ".join(said)))
    s = neural_lm.Settings(classes=8, dim=8, batch=64, rate=0.1, shard=4000)
    df = spark.createDataFrame(rows, DOCS)
    got = [{r.doc_id: r for r in neural_lm.score(df.repartition(n), s=s).collect()} for n in (1, 7)]
    assert all(abs(got[0][i].score - got[1][i].score) < 1e-3 for i in range(400))
    held = [r for r in got[0].values() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert len(held) > 40 and gain > 0.1


def test_scores(spark):
    import math
    import zlib
    from collections import Counter

    rows = [(i, " ".join(words(i, 30, 50)).upper()) for i in range(60)] + [(60, None), (61, ""), (5, " ".join(words(5, 30, 50)))]
    got = neural_lm.score(spark.createDataFrame(rows, DOCS), s=neural_lm.Settings(words=25, classes=5, dim=4, noise=4)).collect()
    counts, texts = Counter(), {}
    for i, t in rows:
        texts[i] = (t or "").encode().lower().split() + [b""]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(texts[i])
    total, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (v + 1))) for w in texts[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 and r.n_tokens == len(texts[r.doc_id]) and r.train_tokens == total
        assert r.n_known == sum(counts[w] > 0 for w in texts[r.doc_id]) and r.score < 0
    assert neural_lm.score(spark.createDataFrame([], DOCS)).count() == 0


# 7. embeddings


def test_pivots_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 32))
    x = np.concatenate([base, base[:60] + 0.05 * rng.normal(size=(60, 32)), base[:20]])
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 32, "x"), (902, [float("nan")] + [1.0] * 31, "x"), (903, [None] + [1.0] * 31, "x"), (904, [], None), (905, [1.0, 2.0], None)]
    got = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.95 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert got[210].component_id == got[0].component_id == got[150].component_id == 0 and got[0].kept and not got[210].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))


@pytest.mark.parametrize("points", [64, 500, 2048])
def test_recall_at_the_limit(points):
    """Pairs at cosine 0.90, the hardest that count, by the number of reference points."""
    rng = np.random.default_rng(points)
    for size in (32, 128):
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        pivots_ = unit(rng.normal(size=(points, size)))
        a = unit(rng.normal(size=(800, size)))
        side = rng.normal(size=a.shape)
        side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
        b = 0.9 * a + np.sqrt(1 - 0.81) * side
        m = pivots.places(8, points)
        near = [pivots.nearest(x, pivots_, m) for x in (a, b)]
        shared = np.array([len(np.intersect1d(x, y)) for x, y in zip(*near, strict=True)])
        assert (shared >= 2).mean() >= 0.95


def test_exact_mode_finds_every_link(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(200, 6))
    x = np.concatenate([base, base[:80] + 0.25 * rng.normal(size=(80, 6)), base[:1] + 0.2 * rng.normal(size=(60, 6))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(df, exact=True).collect()}
    assert [got[i] for i in range(len(x))] == near.sum(axis=1).tolist()
    found = {r.vec_id: r.n_links for r in pivots.near_duplicates(df).collect()}
    assert sum(found.values()) >= 0.95 * near.sum() and all(found[i] <= got[i] for i in got)
    assert pivots.near_duplicates(df.limit(0)).count() == 0


# 8. quality


def test_quality_base(spark):
    text = "a b c a b c x y\n\na b c\n  \n" + "w " * 60
    row = quality.judge(text)
    assert row[:5] == (8 + 3 + 60, 8 + 3 + 60, 0, 0, 69)
    assert quality.judge(None)[:7] == (0, 0, 0, 0, 0, True, False)
    assert quality.judge("| home | #tag\n| home | #tag\n")[2:4] == (6, 1)
    clean = " ".join(f"word{k}" for k in range(60)) + "."
    assert quality.judge(clean)[6] and not quality.judge(clean + "\n" + " ".join(f"#x{k}" for k in range(60)))[6]


def test_quality_lines():
    assert quality.line_fault("home | about | contact | login") == "navigation"
    assert quality.line_fault("BUY!! NOW!! HERE!!") == "punctuation"
    assert quality.line_fault(" ".join(["word"] * 15)) == "punctuation"
    assert quality.line_fault("Licensed under the Apache License, Version 2.0.") == "boilerplate"
    assert quality.line_fault("A plain sentence stands here.") is None and quality.line_fault("  ") is None


def test_wrapped_prose_stays():
    line = "one two three four five six seven eight nine ten eleven twelve thirteen"
    wrapped = "\n".join([line, line, line + " end.", line, "short end."] * 2)
    judged = quality.judge(" ".join(f"w{k}" for k in range(60)) + ".\n" + wrapped.replace(line, " ".join(f"x{k}" for k in range(13))))
    assert judged[8] <= 2
    assert quality.line_fault(line) == "punctuation" and quality.line_fault(line, wrapped=True) is None
    assert quality.line_fault("Alle Rechte vorbehalten.") == "boilerplate" and quality.line_fault("Accueil Suivant Retour") == "navigation"


def test_quality_of_odd_tables(spark):
    clean = " ".join(f"word{k}" for k in range(80)) + "."
    df = spark.createDataFrame([(1, clean, "en"), (1, clean, "en"), (2, None, None), (3, "", "x"), (4, "y " * 300_000, "x")], DOCS + ", n_words string")
    got = sorted((r.doc_id, r.n_words, r.kept) for r in quality.quality(df).collect())
    assert got == [(1, 80, True), (1, 80, True), (2, 0, False), (3, 0, False), (4, 300_000, False)]
    assert quality.quality(df.limit(0)).count() == 0


def test_quality_frame(spark):
    df = spark.createDataFrame([(1, "x", "en", 1)], DOCS + ", kept string, n_chars long")
    assert quality.quality(df).first().kept is False
    assert quality.filter_documents(df).count() == 0


# 9. html


def test_extraction():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><a href=x>one</a></nav>
    <div class="cookie-notice">We use cookies, a lot of them, on every page of this very long site.</div>
    <article><header><h1>Head &amp; tail</h1></header><p>Some  long\n text with many words, &lt;indeed&gt; a lot of them.<p><b>Second</b> one&nbsp;here<br>and after.
    <ul><li>short</ul><script>var a="</p>";</script><section id="comments"><p>Nice post, I liked it very much indeed, thanks.</p></section></article>
    <aside>Side</aside><form>q <input></form><footer>&copy;</footer></body></html>"""
    assert extract.extract(page) == "Head & tail\nSome long text with many words, <indeed> a lot of them.\nSecond one here\nand after.\nshort"
    assert extract.extract(None) == extract.extract("") == extract.extract("<nav>only</nav>") == ""
    assert extract.extract("plain words") == "plain words"
    cut = "<body><div id=main><p>" + "words and more words " * 20
    assert extract.extract(cut) == " ".join(("words and more words " * 20).split())


def test_ratios_choose_the_region(monkeypatch):
    prose = "<p>" + "words of the story told here " * 4 + "</p>"
    links = "<ul>" + "".join(f"<li><a href=x>a link of the list number {k}</a></li>" for k in range(6)) + "</ul>"
    # no element or class says which part is the story: a list with teasers stands beside it
    page = f"<body><div>{(links + '<p>' + 'teaser ' * 16 + '</p>') * 8}</div><div>{prose * 4}<p>Yes.</p>{prose * 5}</div></body>"
    text = extract.extract(page)
    assert "Yes." in text and "link" not in text and "teaser" not in text
    monkeypatch.setattr(extract, "smoothed", lambda x, sigma=1.0: x)
    unsmoothed = extract.extract(page)
    monkeypatch.undo()
    monkeypatch.setattr(extract, "threshold", lambda x: -1.0)
    unclustered = extract.extract(page)
    assert unsmoothed != text and unclustered != text


def test_names_only_assist():
    story = "word " * 40
    for hint in ("legal", "search", "related-work", "has-sidebar", "no-sidebar with-comments"):
        assert story.strip() in extract.extract(f"<article><h1>T</h1><div class='{hint}'><p>{story}</p></div></article>")
        assert story.strip() in extract.extract(f"<div id=content class='{hint}'><h1>T</h1><p>{story}</p></div>")
    page = f"<article><h1>T</h1><p>{story}</p><div class='comments'><p>{'Nice one, thanks. ' * 9}</p></div></article><div class=ad><p>{story}buy</p></div>"
    assert extract.extract(page) == f"T\n{story.strip()}"
    short = "<html><head><title>t</title><body><div>one</div><p>two</body>"
    assert extract.extract(short).split("\n")[-1] in ("one", "two")


def test_no_markup_ends_the_parser():
    for page, text in [("<p>fine</p><![foo[bar]]>", "fine"), ("<![supportlists]>", ""), ("<![ CDATA[x]]>a", "a"), ("<p>x <!-- y", "x"), ("a<b", "a"), ("a < b", "a < b"), ("x &amp", "x &")]:
        assert extract.extract(page) == text
    rng, parts = random.Random(2), ["<", ">", "!", "[", "]", "-", "--", "<!", "<![", "</", "<p>", "<div class=ad>", "</div>", "<script>", "&amp;", "&#x", "a b", '"', "=", "<a href='", "/>", "\n", "<article>", "<br>", "<?x", "é"]
    for _ in range(3000):
        extract.extract("".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))))
    deep = "<div>" * 20_000 + "x" + "</span>" * 20_000
    assert extract.extract(deep) == "x" and extract.extract("<p>" + "long words " * 200_000).count("words") == 200_000


def test_main_text_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "u"), (1, "<p>a</p>", "u")], "page_id long, html string, n_chars string")
    assert [(r.text, r.n_chars) for r in extract.main_text(df).collect()] == [("a", 1)] * 2
    assert extract.main_text(df.limit(0)).count() == 0


def test_main_text(spark):
    df = spark.createDataFrame([(1, "<p>é</p>", "x"), (2, None, "y")], "page_id long, html string, text string")
    assert {(r.page_id, r.text, r.n_chars) for r in extract.main_text(df).collect()} == {(1, "é", 1), (2, "", 0)}


# 10. packing


def brute_fit(items, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [k for k, b in enumerate(bins) if b[0] >= size and (source is None or b[1].count(source) < per_source) and (cluster is None or cluster not in b[2])]
        least = min((bins[k][0] for k in fits), default=None)
        if least is None:
            bins.append([capacity, [], set()])
        k = next((k for k in fits if bins[k][0] == least), len(bins) - 1)
        bins[k][0] -= size
        bins[k][1].append(source)
        bins[k][2].add(cluster)
        out.append(bins[k][0])
    return len(bins), sorted(out)


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(6)
    items = sorted(((rng.randrange(1, 60), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([None, None, 0, 1])) for _ in range(400)), key=lambda x: -x[0])
    bins = packing.Bins(100, 2)
    for size, source, cluster in items:
        tightest = [r for b, r in enumerate(bins.room) if r >= size and bins.counts[b].get(source, 0) < 2 and not (cluster is not None and bins.clusters[b] >> cluster & 1)]
        before = list(bins.room)
        b, offset = bins.place(size, source, 0 if cluster is None else 1 << cluster)
        assert offset == 100 - (before[b] if b < len(before) else 100)
        assert (before[b] == min(tightest)) if tightest else b == len(before)
    assert len(bins.room) == brute_fit(items, 100, 2)[0]


def test_pack(spark):
    rows = [(i, " ".join(words(i, n)), s) for i, (n, s) in enumerate([(25, "a"), (3, "a"), (3, "a"), (3, "b"), (9, None), (0, "b")])] + [(9, None, "c"), (1, " ".join(words(1, 3)), "a")]
    out = packing.pack(spark.createDataFrame(rows, DOCS + ", source string"), capacity=10, per_source=2).collect()
    assert sorted((r.doc_id, r.piece, r.n_words) for r in out) == sorted([(0, 0, 10), (0, 1, 10), (0, 2, 6), (1, 0, 4), (1, 0, 4), (2, 0, 4), (3, 0, 4), (4, 0, 10), (5, 0, 1), (9, 0, 1)])
    by = {}
    for r in out:
        by.setdefault(r.bin_id, []).append(r)
    for bin_ in by.values():
        spans = sorted((r.bin_offset, r.bin_offset + r.n_words) for r in bin_)
        assert spans[-1][1] <= 10 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert sum(r.source == "a" for r in bin_) <= 2 and [r.doc_id for r in bin_].count(1) <= 1
    assert packing.pack(spark.createDataFrame([], DOCS + ", source string")).count() == 0


def test_pack_of_odd_tables(spark):
    rows = [(1, "a b c", "s", "x")] * 40 + [(2, None, None, None), (3, "a b c", None, "y")]
    df = spark.createDataFrame(rows, DOCS + ", source string, bin_id string")
    out = packing.pack(df, capacity=8, per_source=2, shard_rows=10).collect()
    assert len(out) == 42 and sum(r.n_words for r in out) == 40 * 4 + 1 + 4
    by = {}
    for r in out:
        by.setdefault(r.bin_id, []).append(r)
    # copies never share a bin
    assert all(sum(r.n_words == 4 for r in b) <= 1 for b in by.values())
    long = "c" * 40
    labelled = spark.createDataFrame([(1, "a", "s", long + "1"), (2, "b", "s", long + "2")], DOCS + ", source string, label string")
    assert len({r.bin_id for r in packing.pack(labelled, capacity=8, cluster="label").collect()}) == 1


def test_jaccard_of_odd_tables(spark):
    long = " ".join(words(77, 30_000, 20_000))
    rows = [(5, long, "u"), (6, long + " more", "v"), (7, "x y z", "w"), (7, "x y z", "w"), (8, None, None)]
    got = jaccard.keep_one(spark.createDataFrame(rows, DOCS + ", tokens string")).collect()
    assert sorted((r.doc_id, r.tokens or "") for r in got) == [(5, "u"), (7, "w"), (8, "")]
    # two texts under one id are one document, of which no text is lost
    both = [(1, " ".join(words(1, 40))), (1, " ".join(words(2, 40))), (2, " ".join(words(2, 40)))]
    kept = jaccard.keep_one(spark.createDataFrame(both, DOCS)).collect()
    assert sorted(r.text for r in kept) == sorted(t for i, t in both if i == 1)


def test_candidates_grow_with_the_rows(spark, monkeypatch):
    """Ten times the documents that share a passage, none of them alike, make no pairs of them."""
    passage = " ".join(words(3, 50))
    asked = []
    plain = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda pairs, sets, limit: asked.append(pairs.count()) or plain(pairs, sets, limit))
    for n in (60, 600):
        rng = random.Random(n)
        rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(120)) + " " + passage) for i in range(n)]
        assert {r.doc_id == r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(rows, DOCS)).collect()} == {True}
    assert sum(asked) == 0
