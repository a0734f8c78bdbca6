"""Registered queries against DuckDB, the library or brute force on the smallest tables, and the pipeline against its stages' brute force."""

import hashlib
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op4_warc", "op5_chat_format", "op7_embedding_near_dedup", "op12_merkle_manifest", "op13_filter_audit", "quality_base_figures"])
def test_against_sql(spark, name):
    from sparrowgrid.llm import queries as q

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(q.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = q.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_sentencepiece_query(spark, documents):
    import public_tokenizers
    import sentencepiece

    from sparrowgrid.llm import queries as q

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in q.op1_sentencepiece(spark, SF).collect()}
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text, _ in documents:
        ids = sp.encode(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hexed(",".join(map(str, ids))), hexed(sp.decode(ids)))


def test_suffix_query(spark, documents):
    from sparrowgrid.llm import queries as q
    from tests.llm.test_operators import brute_repeats

    want = brute_repeats([(i, (t or "").encode()) for i, t, _ in documents], 50)
    assert [r for r in q.op3_suffix_dedup(spark, SF).collect() if tuple(r)[1:] != want[r.doc_id]] == []


def test_scoring_query(spark, documents):
    import math
    import zlib
    from collections import Counter

    from sparrowgrid.llm import queries as q

    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t, _ in documents}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in q.op6_lm_scoring(spark, SF).collect()}
    assert got.keys() == tokens.keys()
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(w in counts for w in ws), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and r.score < 0


def test_quality_query(spark, documents):
    from sparrowgrid.llm import quality
    from sparrowgrid.llm import queries as q

    want = {i: quality.judge(t)[:7] for i, t, _ in documents}
    got = q.op8_quality_rules(spark, SF).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(documents)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    good = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) == len(good)


def test_extraction_query(spark):
    """The pages' articles, read by what the tables' generator writes: one article element, blocks by their tags."""
    import html
    import re

    from sparrowgrid.llm import queries as q

    def article(page):
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1]
        blocks = re.split(r"</?(?:p|br|h1)[^>]*>", body)
        return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks) if x)

    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in q.op9_html_text(spark, SF).collect()}
    assert [i for i, page in pages if got[i].text != article(page) or got[i].n_chars != len(got[i].text)] == []


def test_packing_query(spark, documents):
    from sparrowgrid.llm import queries as q
    from tests.llm.test_operators import brute_fit

    out = q.op10_best_fit_packing(spark, SF).collect()
    sizes, bins = {}, {}
    for r in out:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_words
        bins.setdefault(r.bin_id, []).append(r)
    assert sizes == {i: len((t or "").encode().split()) + 1 for i, t, _ in documents}
    texts = {i: t for i, t, _ in documents}
    for held in bins.values():
        spans = sorted((r.bin_offset, r.bin_offset + r.n_words) for r in held)
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all([r.source for r in held].count(s) <= 4 for s in {r.source for r in held} - {None})
        copies = [texts[r.doc_id] for r in held if texts[r.doc_id] is not None]
        assert len(copies) == len(set(copies)) or len({r.doc_id for r in held}) < len(held)
    # one shard here: as many bins as best fit over all pieces opens
    pieces = sorted(((r.n_words, r.source, texts[r.doc_id]) for r in out), key=lambda x: -x[0])
    assert len(bins) <= brute_fit(pieces, 2048, 4)[0] + 1


def test_pipeline(spark, documents):
    import corpus_pipeline
    from sparrowgrid.llm.quality import judge
    from tests.llm.test_operators import brute_groups, brute_repeats

    kept = [(i, j[-1]) for i, t, _ in documents for j in [judge(t)] if j[6]]
    groups = brute_groups(kept, 5, 80, 100)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    cut = brute_repeats([(i, t.encode()) for i, t in kept], 50)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {i for i, _ in kept}
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_words
    whole = {i: len(t.encode().split()) + 1 for i, t in kept if not cut[i][1]}
    assert whole and all(total[i] == n for i, n in whole.items())


def test_pipeline_on_odd_rows(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(2)
    prose = lambda: ". ".join(" ".join(f"w{rng.randrange(4000)}" for _ in range(12)) for _ in range(8)) + "."
    rows = [(i, prose(), rng.choice(["en", None]), rng.choice(["s", None]), rng.choice([None, 5])) for i in range(30)]
    odd = [(100, None, "en", "s", 0), (101, "", None, None, None), (102, " \n ", "en", "s", 3), (None, prose(), None, None, None), (103, " ".join(prose() for _ in range(300)), "en", "hot", 1)]
    again = [rows[0], rows[0], (104, rows[1][1], "en", "s", None)]
    docs = spark.createDataFrame(rows + odd + again, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the long text and the one without an id stay, texts without words go, a copy goes to its smaller id, equal rows are one
    assert {r.doc_id for r in out} == {*range(30), None, 103}
    whole = {r[0]: len(r[1].split()) + 1 for r in [*rows, odd[-1]]}
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_words
    assert {i: total[i] for i in whole} == whole
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
