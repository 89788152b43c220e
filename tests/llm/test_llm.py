"""Each operator against a plain version, on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import functools
import random
import zlib

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from gaugeworks.llm import article, lanes, maxscore, mixing, packing, passages, personal, quality, separators, simhash, token_files, vocab
from gaugeworks.llm.common import shared_dir
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, kept boolean, row string, found int"
RNG = random.Random(7)
GOOD = " ".join(RNG.choice(["river", "stone", "cloud", "garden", "winter", "market", "paper", "light"]) + str(i % 83) for i in range(120))
ROWS = [
    (1, GOOD, "en", "a", 1, 9, "x", True, "r", 1), (1, GOOD, "en", "a", 1, 9, "x", True, "r", 1), (2, GOOD + " tail", "en", "b", 1, 9, "x", True, "r", 1),
    (3, None, None, None, None, None, None, None, None, None), (4, "", "en", "a", 0, 0, "", False, "", 0), (None, GOOD.replace("river", "lake"), None, "b", 1, 1, "x", True, "r", 1),
    (5, "one two", "de", None, 7, 1, "", True, "", 1), (6, "word " * 30000, "en", "a", 5, 1, "", True, "", 1), (7, "a\n\nb\tc  d \n", "fr", "c", 5, 1, "", True, "", 1),
    (8, "mail joe.x@host.org or +1 (212) 555-1234, 10.0.0.1, 4111 1111 1111 1111 " + GOOD, "en", "a", 5, 1, "", True, "", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@functools.cache
def tokenizer(file):
    return Tokenizer.from_file(vocab.vocabulary(file))


def ids_of(text, file, end):
    t = tokenizer(file)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_lane_coder_round_trip():
    r = np.random.default_rng(1)
    blocks = [np.zeros(0, np.uint32), np.zeros(1, np.uint32), np.full(3000, 9, np.uint32), r.integers(0, 1 << 16, 2048).astype(np.uint32), np.arange(700, dtype=np.uint32) % 5]
    for more in ([], [r.integers(0, 1 << 32, 500, dtype=np.uint32)]):
        codes = lanes.encode_blocks(blocks + more)
        assert all(np.array_equal(a, b) for a, b in zip(blocks + more, lanes.decode_blocks(codes)))
    broken = bytearray(codes[2])
    broken[20] ^= 1
    with pytest.raises(ValueError):
        lanes.decode_blocks([bytes(broken)])


@pytest.mark.parametrize("file,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_dictionary_gives_the_tokenizers_ids(file, spaced):
    import pyarrow as pa
    letters = ["a", "B", " ", ".", ",", "\n", "'", "s", "é", "1", "\t", "-", "\x0b", "日", "́", " ", "\xa0", "<|endoftext|>"]
    texts = ["".join(RNG.choice(letters) for _ in range(RNG.randint(0, 16))) for _ in range(800)] + [None, "", GOOD]
    ids, count = vocab.Encoder(vocab.vocabulary(file), spaced, not spaced).with_end(pa.array(texts), 3)
    want = [ids_of(t, file, 3) for t in texts]
    assert count.tolist() == [len(w) for w in want] and np.array_equal(ids, np.concatenate(want))


def test_special_strings_can_be_spelled_out():
    import pyarrow as pa
    path = vocab.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    special = [x.content for x in t.get_added_tokens_decoder().values() if x.special][0]
    text = f"one {special} two"
    t.encode_special_tokens = True
    assert vocab.Encoder(path, True, False, special=False).encode(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids
    t.encode_special_tokens = False
    assert vocab.Encoder(path, True, False).encode(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encoded_together(file, spaced):
    enc = vocab.Encoder(vocab.vocabulary(file), spaced, not spaced)
    pieces = ["", "a", *(f"w{i}é," for i in range(200)), "x<|endoftext|>y", "<|endoftext|>", "<|startoftext|>", "<|endoftext|", "|>", "日本 語", *(f"v{i}" for i in range(70))]
    calls, tok = [], enc.tok

    class Counted:
        encode_special_tokens = property(lambda self: tok.encode_special_tokens, lambda self, v: setattr(tok, "encode_special_tokens", v))

        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return tok.encode_batch_fast(texts, **more)

    enc.tok = Counted()
    ids, size = enc._ids(pieces)
    want = [e.ids for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]   # special strings are spelled out
    assert size.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert len(calls) < len(pieces) / 2   # one text for many pieces, and one by one only beside special strings


def test_token_files(spark, docs, none):
    folder = shared_dir(spark, "t")
    token_files.write_ids(docs, folder)
    got = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    texts, at = {r[0]: r[1] for r in ROWS}, 0
    for r in got:
        w = ids_of(texts[r["doc_id"]], "word_bpe_49k.json", 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(w), zlib.crc32(w.tobytes()))
        at += len(w)
    folder = shared_dir(spark, "t")
    token_files.write_ids(none, folder)
    assert token_files.read_ids(spark, folder).count() == 0


def test_packing(docs, none):
    got = packing.pack_texts(docs).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    full = got.groupby("sequence_id").length.sum()
    assert sum(2048 - n for n in full if n & (n - 1)) == 0
    texts = {r[0]: r[1] for r in ROWS}
    assert got.length.sum() == sum(len(ids_of(r[1], "byte_bpe_50k.json", 1)) for r in ROWS)
    for r in got.itertuples():
        w = ids_of(texts[None if pd.isna(r.doc_id) else r.doc_id], "byte_bpe_50k.json", 1)
        assert r.doc_tokens == len(w) and r.ids_crc32 == zlib.crc32(w[r.start:r.start + r.length].tobytes())
    assert packing.pack_texts(none).count() == 0


def test_packing_of_examples_keeps_all_limits(spark):
    rows = [(str(i), RNG.randint(1, 900), RNG.randint(0, 300)) for i in range(400)] + [("big", 5000, 1), ("none", None, None)]
    got = packing.pack_items(spark.createDataFrame(rows, "k string, t long, l long"), "k", "t", "l", 1024, 4, 512).toPandas()
    assert sorted(got.item_id) == sorted(r[0] for r in rows)
    g = got[got.item_id != "big"].groupby("sequence_id")
    assert g.n_tokens.sum().max() <= 1024 and g.n_loss.sum().max() <= 512 and g.size().max() <= 4


def test_mixing(docs, none):
    got = mixing.mix_sizes(docs).toPandas()
    assert len(got) == len(ROWS) and (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source_size").target.first()
    assert abs(got.drop_duplicates("source_size").target.sum() - 1.5 * got["size"].sum()) < 1e-6 or (per <= 2 * per.index).all()
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == got.copies.sum()
    assert mixing.mix_sizes(none).count() == 0 and mixing.mix_rows(none).count() == 0


def test_quality(docs, none):
    got = quality.quality(docs).collect()
    want = {r[0]: brute.quality(r[1]) for r in ROWS}
    for r in got:
        n, chars, symbols, lines, repeats = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n) and (not r["kept"] or not r["base_failed"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality.quality(none).count() == 0 and quality.keep_good(none).count() == 0


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).toPandas()
    texts = {r[0]: r[1] for r in ROWS}
    for r in got.itertuples():
        assert r.fingerprint == f"{brute.simhash(texts[None if pd.isna(r.doc_id) else int(r.doc_id)]):016x}"
    fps = [int(x, 16) for x in got.fingerprint]
    want = brute.groups(fps, 2)
    for i, r in enumerate(got.itertuples()):
        mine = [d for d, g in zip(got.doc_id, want) if g == want[i] and not pd.isna(d)]
        assert (min(mine) if mine else None) == (None if pd.isna(r.component_id) else r.component_id)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(want))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_keep_first_of_null_and_repeated_ids(spark):
    words = "one two three four five six"
    rows = [(None, words, "a"), (None, words, "b"), (7, "some other text of its own", "c"), (7, "some other text of its own", "d"), (9, words, "e"), (3, None, "f"), (4, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    kept = sorted((r["doc_id"], r["text"] or "") for r in simhash.keep_first(docs).collect())
    assert kept == [(3, ""), (7, "some other text of its own"), (9, words)]
    alone = simhash.keep_first(docs.where("doc_id is null")).collect()
    assert len(alone) == 1 and alone[0]["doc_id"] is None and alone[0]["fp"] in "ab"


def test_simhash_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    base, fps = RNG.getrandbits(64), set()
    while len(fps) < 300:
        x = base
        for _ in range(RNG.randint(0, 4)):
            x ^= 1 << RNG.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    got = simhash.fingerprint_groups(spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long"), F.col("doc_id")).collect()
    by = {r["fp"] & simhash._M64: r["component_id"] for r in got}
    want = brute.groups(fps, 2)
    assert [by[x] for x in fps] == [want.index(g) for g in want]


def test_personal(spark, docs, none):
    texts = [r[1] for r in ROWS] + ["a@b.c+d@e.f @x.y", "4111-1111-1111-11111111", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "é😀 a@b.co 😀 1.2.3.4", "+1-2 3456 7890 ( x",
                                    "1" * 3000, "1 " * 3000, "a@" * 800, "1." * 400, "+1 2" + " (" * 500]
    got = personal.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        counts, digest, spelled = brute.personal(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts and r["base_sha256"] == digest
        assert set(filter(None, spelled.split(","))) <= set(r["spans"].split(","))
    clean = {r["doc_id"]: r for r in personal.redact(docs).collect()}
    assert clean[8]["text"] == "mail [EMAIL] or [PHONE], [IP], [CARD] " + GOOD and clean[8]["n_chars"] == len(clean[8]["text"])
    assert clean[3]["text"] is None and clean[1]["text"] == GOOD and personal.redact(docs).columns == docs.columns
    assert personal.find_spans(none).count() == 0 and personal.redact(none).count() == 0


def test_personal_adds_spans_with_context(spark):
    rows = [(i, f"phone: 212-555-{1000 + i}. mail joe{i} (at) host (dot) com") for i in range(30)]
    got = personal.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("phone:7:19" in r["spans"] and "email:" in r["spans"] and r["n_phone"] == 0 for r in got)


def test_maxscore(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), r.normal(size=16).tolist()) for i in range(700)] + [(800, [0.5] * 16), (900, [0.5] * 16), (801, [0.5] * 16), (1000, None), (1001, [float("nan")] * 16), (None, [1.0] * 16), (1002, [None] * 16), (1100, [])]
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    good = {i: np.floor(1024 * np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in good if i % 100 == 0]:
        dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
        want = sorted((-dot(good[q], v), i) for i, v in good.items() if i != q)[:10]
        assert [(-x["score"], x["vec_id"]) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == want
    assert maxscore.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_separators(spark, docs, none):
    folder = shared_dir(spark, "t")
    order = separators.write_flat(docs, folder)
    whole, small = (separators.count_tokens(spark, folder, block=b).toPandas().sort_values("start").reset_index(drop=True) for b in (1 << 20, 50))
    pd.testing.assert_frame_equal(whole, small)
    got = order.join(separators.count_tokens(spark, folder), ["file", "ordinal"]).collect()
    texts = {r[0]: r[1] for r in ROWS}
    assert len(got) == len(ROWS) and all(r["n_tokens"] == len(ids_of(texts[r["doc_id"]], "byte_bpe_50k.json", 0)) for r in got)
    folder = shared_dir(spark, "t")
    separators.write_flat(none, folder)
    assert separators.count_tokens(spark, folder).count() == 0


def test_articles(spark):
    text = "One, two, three, and a sentence that is long enough to count."
    page = (f'<html><nav><a href="/">home</a></nav><div class="ad">Buy</div><article><h1>T &amp; U</h1><p>{text}<p>x&nbsp; y<br>z</p><script>var a="</p>";</script></article>'
            f'<div id="comments"><p>{text} {text}</p></div><aside>{text}</aside><form><p>{text}</p></form><footer>f</footer>')
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain"), (5, "u", "<b>" * 3000 + "<p>x" * 300), (6, "u", "<div>" * 3000 + text)]
    got = {r["page_id"]: r for r in article.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == f"T & U\n{text}\nx y z" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "plain" and got[6]["text"] == text


def test_passages(spark, none):
    v = [f"w{i}" for i in range(3000)]
    shared = [RNG.choice(v) for _ in range(80)]
    fuzzy = [RNG.choice(v) if i in (20, 45, 70) else w for i, w in enumerate(shared)]
    pad = lambda: [RNG.choice(v) for _ in range(40)]
    rows = [(1, " ".join(pad() + shared + pad())), (2, " ".join(pad() + fuzzy)), (3, " ".join(pad() + pad() + pad())), (4, None), (None, " ".join(shared)), (5, ""), (6, "z " * 400), (7, "z " * 400),
            (8, " ".join(shared[:30] + pad())), (7, "z " * 400)]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(2, 1), (7, 6)}
    first = next(r for r in got if r["doc_id"] == 2)
    assert (first["start"], first["end"], first["other_start"], first["other_end"]) == (40, 120, 40, 120) and first["n_matched"] == 77
    assert passages.shared_passages(none).count() == 0


LINE = "The river ran past the old mill, and the stones were cold, he wrote, in the winter of that year."
BODY = f"<h1>Title</h1><p>{LINE}</p><p>{LINE}</p>"


@pytest.mark.parametrize("page", [
    f'<article class="post comments-open">{BODY}</article>', f'<div id="content" class="no-comments">{BODY}</div>', f'<main><div class="has-sidebar">{BODY}</div></main>',
    f'<main><div title="the hidden gem">{BODY}</div></main>', f'<form id="page"><input name="q"><article>{BODY}</article></form>',
    f'<article>{BODY}</article><div class="post-comments"><p>{LINE}</p></div><form><p>{LINE}</p></form><div hidden><p>{LINE}</p></div><div style="display: none"><p>{LINE}</p></div>'
    f'<ul class="comment-list"><li>{LINE}</li></ul><div aria-hidden="true">{LINE}</div>'])
def test_articles_by_whole_names(page):
    assert article.extract(page).split("\n") == ["Title", LINE, LINE]


def test_articles_keep_marked_paragraphs_and_short_neighbours():
    page = f'<main><article>{BODY}<p class="promoted">One.</p><p class="dialog-share">Two.</p></article><article><p>Three.</p></article></main>'
    assert article.extract(page).split("\n") == ["Title", LINE, LINE, "One.", "Two.", "Three."]


def test_articles_of_no_pages_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert article.extract_articles(spark.createDataFrame([], schema)).count() == 0
    got = article.extract_articles(spark.createDataFrame([(1, "u", f"<main>{BODY}</main>", "x", 3), (None, None, None, None, None)], schema)).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", len(f"Title\n{LINE}\n{LINE}")), ("None", 0)]


def test_articles_keep_all_sections():
    long = "One, two, three, and a sentence that is long enough to count, with more words so that it has points, and then some."
    brief = "A section with one paragraph, of some hundred and fifty characters, which has few points of its own beside a section of twelve paragraphs in it."
    first = "".join(f"<p>{long} {i}</p>" for i in range(12))
    rest = f"<section><h2>B</h2><p>{brief}</p></section><section><h2>C</h2><ul><li>tea</li><li>milk</li></ul></section>"
    links = '<div><a href="/a">other page</a> <a href="/b">another page</a></div>'
    want = [f"{long} {i}" for i in range(12)] + ["B", brief, "C", "tea", "milk"]
    for page in (f"<main><section>{first}</section>{rest}{links}</main>", f"<body><div><section>{first}</section>{rest}{links}</div></body>",
                 f'<div class="content"><div><section>{first}</section></div><div>{rest}</div>{links}</div><nav>menu</nav>'):
        assert article.extract(page).split("\n") == want


def _fresh(tag, n):
    return [f"{tag}{i}" for i in range(n)]


def test_passages_two_in_one_pair(spark):
    a, b = _fresh("a", 100), _fresh("b", 80)
    c, d = _fresh("c", 100), _fresh("d", 60)
    rows = [(1, " ".join(a + _fresh("p", 100) + b)), (2, " ".join(a + _fresh("q", 100) + b)), (3, " ".join(c + _fresh("r", 22) + d)), (4, " ".join(c + _fresh("s", 22) + d))]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["other_id"], r["start"], r["end"]) for r in got) == [(2, 1, 0, 100), (2, 1, 200, 280), (4, 3, 0, 100), (4, 3, 122, 182)]


def test_passages_whose_seeds_have_other_holders(spark):
    a, b = _fresh("a", 60), _fresh("b", 120)
    own = lambda tag: _fresh(f"x{tag}_", 30)
    rows = [(i, " ".join(own(i) + a[:30] + own(f"{i}e"))) for i in (1, 9, 6)] + [(i, " ".join(own(i) + a[30:] + own(f"{i}e"))) for i in (2, 8)]
    rows += [(i, " ".join(own(i) + a + own(f"{i}e"))) for i in (5, 7)]
    rows += [(i, " ".join(own(i) + b[25:95] + own(f"{i}e"))) for i in (101, 109)] + [(i, " ".join(own(i) + b + own(f"{i}e"))) for i in (105, 107)]
    got = {(r["doc_id"], r["other_id"]): (r["start"], r["end"], r["n_matched"]) for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[7, 5] == (30, 90, 60) and got[107, 105] == (30, 150, 120)


def test_passages_of_many_holders_meet_in_all_pairs(spark, monkeypatch):
    a = _fresh("a", 60)
    texts = {i: " ".join(_fresh(f"x{i}_", 30) + a + _fresh(f"y{i}_", 30)) for i in range(1, 13)}
    rows = [*texts.items(), (20, texts[3]), (2, texts[3]), (0, texts[7])]
    got = sorted((r["doc_id"], r["other_id"], r["start"], r["end"]) for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # texts 3 and 7 are stood for by documents 2 and 0; document 2 has two texts
    assert [g for g in got if g[2:] == (0, 120)] == [(3, 2, 0, 120), (7, 0, 0, 120), (20, 2, 0, 120)]
    reps = [0, 1, 2, 4, 5, 6, 8, 9, 10, 11, 12]
    assert {g[:2] for g in got if g[2:] == (30, 90)} == {(p, q) for p in reps for q in reps if p > q}

    h, same, doc, pos = (np.array(c) for c in zip(*sorted((h, d % 9, d, p) for h in (-4, 7) for d in range(40) for p in (3, 8)[:1 + d % 2])))
    whole = [np.concatenate(c).tolist() for c in zip(*passages.matches(h, same, doc, pos))]
    monkeypatch.setattr(passages, "SLAB", 5)
    parts = [np.concatenate(c).tolist() for c in zip(*passages.matches(h, same, doc, pos))]
    assert whole == parts and {p for p in zip(*whole[:2])} == {(p, q) for p in range(9) for q in range(p)}
    assert len(whole[0]) == len(set(zip(*whole))) * 2  # both seeds have the same places


def test_passages_of_common_lines_meet_only_near_other_seeds(monkeypatch):
    line, wide = _fresh("line", 8), _fresh("wide", 24)
    texts = []
    for i in range(60):
        own = lambda t: _fresh(f"x{i}{t}_", 30)
        kind = i % 3
        texts.append(own("a") + line + own("b") + (wide if kind == 1 else line + own("c") if kind == 2 and i % 2 else []) + (_fresh(f"pair{i // 2}_", 20) if i < 20 else []) + own("d"))
    rows = [(h, i, i, p) for i, w in enumerate(texts) for h, p in zip(*map(np.ndarray.tolist, passages.seeds(" ".join(w))))]
    texts_of = {h: {i for g, i, _, _ in rows if g == h} for h in {x[0] for x in rows}}
    rows = sorted(x for x in rows if len(texts_of[x[0]]) > 1)

    def made(hot):
        by_text = sorted(rows, key=lambda x: (x[2], x[1], x[3], x[0]))
        cols = [np.array([x[k] for x in by_text]) for k in range(4)]
        batch = passages._batch((*cols, np.array([len(texts_of[x[0]]) > hot for x in by_text])), passages.SHARED_SCHEMA)
        # small batches, whose cuts fall within texts and seeds
        got = pa.Table.from_batches(list(passages._context_rows(batch.slice(k, 7) for k in range(0, len(by_text), 7))))
        got = got.sort_by([(k, "ascending") for k in ("h", "same", "doc_id", "pos")]).combine_chunks().to_batches()[0]
        out = [b.to_pydict() for b in passages._match_rows(got.slice(k, 5) for k in range(0, got.num_rows, 5))]
        return [(hi, lo, x, y) for b in out for hi, lo, c in zip(*b.values()) for x, y in np.frombuffer(c, "<i4").reshape(-1, 2).tolist()]

    def kept(found):
        out = {}
        for hi, lo in {m[:2] for m in found}:
            x, y = (np.array(c) for c in zip(*sorted({m[2:] for m in found if m[:2] == (hi, lo)})))
            got = [tuple(zip(x[c].tolist(), y[c].tolist())) for c in passages.chains(x, y) if min(np.ptp(x[c]), np.ptp(y[c])) + passages.K >= passages.SPREAD]
            out.update({(hi, lo): sorted(got)} if got else {})
        return out

    every = made(10 ** 9)
    for slab in (passages.SLAB, 9):
        monkeypatch.setattr(passages, "SLAB", slab)
        monkeypatch.setattr(passages, "GATHERED", 8 * slab)
        few = made(2)
        assert set(few) <= set(every) and kept(few) == kept(every)
        assert 2 * len(set(few)) < len(set(every))


def test_passages_of_very_many_holders_follow_from_a_hub(spark):
    a, b = _fresh("a", 60), _fresh("b", 60)
    own = lambda i, t: _fresh(f"x{i}{t}_", 20)
    texts = {i: own(i, "p") + (a if i < 31 else b) + own(i, "q") for i in range(1, 61)}
    texts[101], texts[102] = own(101, "p") + a + b + own(101, "q"), own(102, "p") + a[30:] + b[:30] + own(102, "q")
    texts |= {i: own(i, "p") + ["the"] * (i - 150) + own(i, "q") for i in range(210, 250)}
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()
    pairs = {(r["doc_id"], r["other_id"]): (r["start"], r["end"], r["other_start"], r["other_end"]) for r in got}
    assert len(got) == len(pairs) <= 140      # 30 * 29 + 40 * 39 / 2 and more in all pairs
    # two texts share what their places in a hub have in common
    for group, words in ((range(1, 31), lambda i: 60), (range(31, 61), lambda i: 60), (range(210, 250), lambda i: i - 150)):
        hub = max(group, key=lambda i: sum(i in p for p in pairs))
        for i in set(group) - {hub}:
            place = pairs[max(i, hub), min(i, hub)]
            assert place[0] == place[2] == 20 and place[1] == place[3] == 20 + min(words(i), words(hub))
    assert (101, 1) in pairs and (101, 31) in pairs
    assert pairs[102, 101] == (20, 80, 50, 110)     # too little of either hub


def test_passages_by_runs_of_one_word_keep_few_seeds():
    h, pos = passages.seeds("the " * 400)
    assert len(h) < 60 and (np.diff(np.sort(pos)) <= passages.RUN + passages.WINDOW).all()
    broken, _ = passages.seeds(" ".join((["the"] * 12 + ["x"]) * 30))
    assert len(set(h.tolist()) & set(broken.tolist())) > 15


def _found(r, n, rate):
    """Whether a passage of n words with a share of words changed is found between two texts."""
    a, pad = _fresh("a", n), lambda t: _fresh(t, 60)
    b = [f"y{i}" if i in set(r.sample(range(n), round(n * rate))) else w for i, w in enumerate(a)] if rate else a
    x, y = pad("p") + a + pad("q"), pad("u") + b + pad("v")
    s, t = (list(zip(*map(np.ndarray.tolist, passages.seeds(" ".join(w))[:2]))) for w in (x, y))
    both = sorted((p, q) for h, p in s for g, q in t if h == g)
    if not both:
        return False
    px, py = (np.array(c) for c in zip(*both))
    return any(passages.align(x, y, px[c].tolist(), py[c].tolist()) for c in passages.chains(px, py)
               if min(px[c[-1]] - px[c[0]], py[c[-1]] - py[c[0]]) + passages.K >= passages.SPREAD)


@pytest.mark.parametrize("n,rate,least", [(55, 0.08, 0.97), (60, 0.10, 0.95), (80, 0.15, 0.95)])
def test_passages_with_changed_words(n, rate, least):
    r = random.Random(n)
    assert sum(_found(r, n, rate) for _ in range(100)) >= 100 * least


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, out = set(docs.columns), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert set(out.columns) == want and out.count() > 0, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_packing_looks_at_different_vectors_only():
    rng, pool = np.random.default_rng(3), packing.Pool(2048, 256, 2048, cut=True)
    sizes = rng.integers(1, 90, 4000).tolist()
    for k, n in enumerate(sizes):
        pool.add(n, n, k)
    assert len(pool.wait) <= 89
    taken, first = dict.fromkeys(range(4000), 0), {}
    while pool.waiting:
        got = pool.sequence()
        assert sum(t for _, t, _ in got) == 2048 or len(got) == 256 or not pool.waiting
        for k, t, rest in got:
            taken[k] += t
            if not rest and taken[k] == t:
                assert first.get(t, -1) < k      # of equals the one that came first
                first[t] = k
    assert list(taken.values()) == sizes
