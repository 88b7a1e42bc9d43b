"""Decontamination, classifiers, URL rules and the token file."""

import fnmatch
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.llm import decontaminate, language_id, token_file, toxicity, url_filter
from stratalog.llm.textkit import flat

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def morse_pair(rounds):
    """Two different words of 2**rounds letters."""
    one, two = "a", "b"
    for _ in range(rounds):
        one, two = one + two, two + one
    return one, two


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    seq = rng.integers(1, 5, 300)
    index = decontaminate.FMIndex(seq, 5)
    phrases = np.zeros((40, 4), np.int64)
    lengths = rng.integers(1, 5, 40)
    for p, n in zip(phrases, lengths, strict=True):
        p[4 - n :] = rng.integers(1, 5, n)
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
        found = sorted(index.locate(np.arange(a, max(a, b))).tolist())
        assert found == [i for i in range(300 - n + 1) if (seq[i : i + n] == p[4 - n :]).all()]


@pytest.mark.parametrize("pass_bytes", [decontaminate.PASS_BYTES, 600])
def test_contamination(spark, tricky, rows, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    items = [(1, rows[12][1][:400]), (2, "two words"), (10, "a b c d e"), (3, None), (4, "..."), (5, rows[16][1]), (2, "iota"), (6, ""), (None, "kappa")]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).update(set() if item is None else {str(item)})
    want = Counter()
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for window, owners in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= owners
        want[i, len(w), len(hit), len(found), ",".join(sorted(found))] += 1
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(tricky, benchmark).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in got) == want


def test_clean_text_cuts_the_spans(spark):
    docs = spark.createDataFrame([(1, "ab two words cd"), (2, "none"), (3, None)], "doc_id long, text string")
    got = decontaminate.clean_text(docs, spark.createDataFrame([(1, "Two  words")], "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, "ab  cd"), (2, "none"), (3, None)}


def test_no_benchmark_and_no_documents(spark, tricky, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(tricky, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(nothing, none).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    clean = ["river", "stone", "bread", "house", "green", "walk", "paper", "light"]
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [str(x) for x in rng.choice(clean, 20)] + (["grumpelfoo"] * 2 if bad else [])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(1000, "stone grumpelfooo bread river house"), (1001, None), (1002, ""), (1003, "stone bread " * 5000), (None, "river")]
    labels += [(1, None), (None, 1), (2, 7)]
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == (i % 4 == 0) for i in range(400) if by[i]["held_out"])
    assert by[1000]["predicted"] == 1  # a misspelling never seen
    assert by[1003]["predicted"] == 0
    assert by[7]["held_out"] == (zlib.crc32(b"7") % 5 == 0)


def test_toxicity_never_reads_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"text of {i}") for i in range(200)], "doc_id long, text string")
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    samples = []
    for flip in (0, 1):
        labels = [(i, (i % 4 == 0) ^ (flip and i in held)) for i in range(200)] + [(3, 1), (3, 0), (5, 0), (5, 0)]
        table = spark.createDataFrame([(i, int(t)) for i, t in labels], "doc_id long, toxic int")
        settings = toxicity.Settings(rows_per_class=(40, 20))
        texts, toxic, weight = toxicity.labelled_sample(docs, table, lambda c: ~toxicity.in_fold(c, 5, 0), settings, "doc_id", "text", "toxic")
        samples.append((texts, toxic.tolist(), weight.tolist()))
        assert "text of 3" not in texts and texts.count("text of 5") <= 1
    assert samples[0] == samples[1]


def test_toxicity_scores_as_a_plain_version(spark, tricky, rows):
    """Scores recomputed from the fitted weights, n-gram by n-gram."""
    rng = np.random.default_rng(4)
    settings = toxicity.Settings(bits=12)
    texts = [" ".join(str(w) for w in rng.choice(["river", "Stone", "vile's", "été"], 9)) for _ in range(60)]
    model = toxicity.fit(texts, (np.arange(60) % 3 == 0).astype(np.int64), settings)

    def bucket(gram):
        value = (int.from_bytes(gram, "big") * int(toxicity.GOLD) + len(gram)) % (1 << 64)
        value = ((value ^ (value >> 29)) * int(toxicity.MIX_A)) % (1 << 64)
        return value >> (64 - settings.bits)

    def plain(text):
        lowered = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in (text or "").encode())
        grams = [bucket((b" " + w + b" ")[k : k + n]) for w in lowered.split(b" ") if w for n in toxicity.SIZES for k in range(len(w) + 3 - n)]
        return 1 / (1 + np.exp(-(sum(float(model.weight[g]) for g in grams) / (len(grams) + settings.padding) + model.bias)))

    want = sorted((i is not None, i or 0, round(plain(t), 9)) for i, t, *_ in rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, round(r["score"], 9)) for r in toxicity.scored(tricky, model).collect())
    assert got == want


def test_kneser_ney_as_a_plain_version():
    """Every probability of the model against counts taken with dictionaries."""
    texts = ["abracadabra", "banana band", "abba cab"]
    model = language_id.fit_model(*flat(pa.array(texts)))
    lead = " " * (language_id.ORDER - 1)
    padded = [lead + t for t in texts]
    count = [Counter(p[k - n + 1 : k + 1] for p in padded for k in range(len(lead), len(p))) for n in range(1, language_id.ORDER + 1)]
    for n in range(language_id.ORDER - 1):  # lower orders: distinct left neighbours
        count[n] = Counter(g[1:] for g in Counter(p[k - n - 1 : k + 1] for p in padded for k in range(len(lead), len(p))))

    def chance(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(count[0]) + 1)
        own = count[n - 1]
        ones, twos = (sum(v == x for v in own.values()) for x in (1, 2))
        discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        total, kinds = sum(v for g, v in own.items() if g[:-1] == gram[:-1]), sum(g[:-1] == gram[:-1] for g in own)
        return max(own[gram] - discount, 0) / total + discount * kinds / total * chance(gram[1:]) if total else chance(gram[1:])

    for p in padded:
        for k in range(len(lead), len(p)):
            gram = p[k - language_id.ORDER + 1 : k + 1]
            h = language_id.gram_hashes(np.array([ord(c) for c in gram], np.uint32))
            own, before = [x[-1:] for x in h], [h[0][-1:], h[0][-1:], *(x[-2:-1] for x in h[1 : language_id.ORDER])]
            assert float(np.exp(model.log_probability(own, before))[0]) == pytest.approx(chance(gram), rel=1e-5)


def test_long_words_of_few_letters_are_told_apart(spark):
    one, two = morse_pair(10)
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(7, one)], "item_id long, text string"))
    assert {(r["doc_id"], r["n_hit"]) for r in got.collect()} == {(1, 1), (2, 0)}


def test_toxicity_without_labels(spark, tricky, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(tricky, none).where("predicted = 1").count() == 0
    assert toxicity.toxicity(nothing, none).count() == 0


def test_kneser_ney_sums_to_one():
    texts = ["abracadabra", "banana band", "abba"]
    model = language_id.fit_model(*flat(pa.array(texts)))
    for context in ("    ", "abra", "  ba", "zzzz"):
        total = 0.0
        for c in [*"abcdnr ", "q"]:
            sym = np.array([ord(x) for x in context + c], np.uint32)
            h = language_id.gram_hashes(sym)
            own = [x[-1:] for x in h]
            before = [h[0][-1:], h[0][-1:], *(x[-2:-1] for x in h[1 : language_id.ORDER])]
            total += float(np.exp(model.log_probability(own, before))[0])
        assert total == pytest.approx(1.0, abs=1e-5)


def test_toxicity_cut_counts_rows_by_their_draw_rate(spark):
    rng = np.random.default_rng(7)
    docs = [(i, f"{i} " + " ".join(rng.choice(["mild", "plain", "vile", "sour"], 12, p=[0.3, 0.3, 0.2, 0.2] if i % 2 else [0.2, 0.2, 0.3, 0.3])), int(i % 2 == 0 and i % 5 > 0)) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    settings = toxicity.Settings(bits=12, rows_per_class=(90, 200), calibration=0.5)
    texts, toxic, weight = toxicity.labelled_sample(table.drop("toxic"), table, lambda c: F.lit(True), settings, "doc_id", "text", "toxic")
    clean = sum(1 - t for *_, t in docs)
    assert set(weight[toxic == 0]) == {clean / 90} and set(weight[toxic == 1]) == {(600 - clean) / 200}
    model, unweighted = toxicity.fit(texts, toxic, settings, weight), toxicity.fit(texts, toxic, settings)
    aside = np.random.default_rng(settings.seed).random(len(texts)) < settings.calibration
    logits = model.logits(*flat(pa.array([t for t, a in zip(texts, aside, strict=True) if a], pa.string())))
    toxic, weight = toxic[aside], weight[aside]

    def f1(flagged):
        return 2 * weight[flagged & (toxic == 1)].sum() / (weight[flagged].sum() + weight[toxic == 1].sum())

    assert f1(logits >= 0) >= max(f1(logits >= x) for x in logits) - 1e-9
    assert model.bias < unweighted.bias


def test_languages(spark):
    rng = np.random.default_rng(3)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["été", "qué", "zaña", "wu"], "cc": ["中文", "水", "山川"]}
    docs = [(i, " ".join(str(w) for w in rng.choice(words[k], 12)), k) for i, k in enumerate(list(words) * 60)]
    docs += [(900, None, "aa"), (901, "12 !! 3", "aa"), (902, "", None), (903, "LOREM", None), (None, "wu", "bb"), (905, "wu " * 20000, None)]
    got = language_id.languages(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs)
    assert all(by[i]["lang_pred"] == k for i, _, k in docs[:180] if by[i]["held_out"])
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903, 905)] == ["und", "und", "und", "aa", "bb"]
    assert by[5]["held_out"] == (zlib.crc32(b"5") % 4 == 2)


def test_more_languages_than_64(spark):
    rng = np.random.default_rng(6)
    docs = []
    for k in range(70):
        letters = [chr(0x4E00 + 20 * k + i) for i in range(20)]
        docs += [(len(docs) + i, " ".join("".join(rng.choice(letters, 3)) for _ in range(30 if k else 3)), f"l{k}") for i in range(6)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    few = language_id.fit(table, F.lit(True), language_id.Settings(bytes_per_language=10))
    assert few.languages == sorted({lang for *_, lang in docs})  # a share below one text still learns the language
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.languages(table).collect()}
    assert got == {i: lang for i, _, lang in docs}


def test_languages_without_labels(spark, nothing):
    assert language_id.languages(nothing).count() == 0
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.languages(one).first()["lang_pred"] == "und"


def test_automaton_against_globs():
    rng = np.random.default_rng(5)
    globs = ["".join(rng.choice(list("ab*?"), rng.integers(1, 7))) for _ in range(60)]
    texts = ["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(80)]
    codes = {"*": url_filter.STAR, "?": url_filter.ANY}
    got = url_filter.Automaton([[codes.get(c, ord(c)) for c in g] for g in globs]).fits(*flat(pa.array(texts)))
    assert got.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_urls(spark):
    rules = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "com", "/de/")]
    urls = ["http://a.example.org/es/1", "http://example.org/en/", "https://X.COM/de/x?y", "http://com/de/", "http://org.net/a.org/b", None, "no scheme", "http://hé.org", "http://evil\x00org/", "http://x.org/" + "a" * 5000, "", "http://a.com/de"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = [(r["host"], r["rule"], r["verdict"]) for r in url_filter.judged_urls(pages, rules).orderBy("page_id").collect()]
    assert got[0] == ("a.example.org", "example.org/es/", "block")
    assert got[1] == ("example.org", "org/", "allow")
    assert got[2] == ("x.com", "com/de/", "block")
    assert got[3] == ("com", "com/de/", "block")
    assert got[4] == ("org.net", None, "allow")
    assert got[5] == got[6] == got[10] == ("", None, "allow")
    assert got[7][1] is None and got[8][1] is None and got[9][1] == "org/" and got[11][1] is None
    assert url_filter.judged_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judged_urls(pages, []).where("verdict = 'allow'").count() == len(urls)


def test_blocks_round_trip_and_notice_damage():
    rng = np.random.default_rng(6)
    lengths = np.array([4096, 4096, 700])
    ids = rng.integers(0, 50257, (3, 4096))
    ids[1] = rng.integers(0, 30, 4096)
    data = token_file.encode_blocks(ids, lengths)
    for block, row, n in zip(token_file.decode_blocks(data), ids, lengths, strict=True):
        assert (block == row[:n]).all()
    assert len(data[1]) < 4096  # thirty ids need five bits, not sixteen
    assert (token_file.decode_blocks([data[2]])[0] == ids[2, :700]).all()  # a block can be read alone
    broken = bytearray(data[0])
    broken[200] ^= 1
    with pytest.raises(ValueError):
        token_file.decode_blocks([bytes(broken)])


def test_token_file(tricky, rows, nothing, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = token_file.token_report(tricky, path, str(tmp_path / "f")).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_file.token_report(nothing, path).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "\n\nx", "it's\n ok", "x \n y", "  q", "q　 z", "a  b", "\u0085 c", "<|endoftext|> d", "tail\n", "don't 12,3 .. ?!"])
def test_stretches_tokenize_as_the_whole(text):
    public = pytest.importorskip("public_tokenizers")
    encoder = token_file.Encoder(public.path("byte_bpe_50k.json"))
    ids, per = encoder.encode(*flat(pa.array([text, text + " x"])))
    for t, part in zip([text, text + " x"], np.split(ids, np.cumsum(per)[:-1]), strict=True):
        assert part.tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "a  <|endoftext|>  b", "a\n<|endoftext|>\nb", "a \n <|endoftext|><|endoftext|> b", "a  <b", "a\n<b"])
def test_special_tokens_as_the_unmodified_tokenizer(text):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    ids, _ = token_file.Encoder(path).encode(*flat(pa.array([text])))
    assert ids.tolist() == [*tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]


def test_long_texts_of_few_letters_have_their_own_tokens():
    """Pairs that a polynomial hash modulo 2**64 takes for one another."""
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    one, two = morse_pair(11)
    path = public.path("byte_bpe_50k.json")
    plain, own = tokenizers.Tokenizer.from_file(path), token_file.Encoder(path)
    ids, per = own.encode(*flat(pa.array([one, two, " " + one, " " + two])))
    for t, part in zip([one, two, " " + one, " " + two], np.split(ids, np.cumsum(per)[:-1]), strict=True):
        assert part.tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]


def test_stretches_are_looked_up_without_hashing_all_known_ones(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    own, hashed, real = token_file.Encoder(public.path("byte_bpe_50k.json")), [], token_file.hashes_of
    monkeypatch.setattr(token_file, "hashes_of", lambda strings: hashed.append(len(strings)) or real(strings))
    own.encode(*flat(pa.array([" ".join(f"w{i}" for i in range(50_000))])))
    own.encode(*flat(pa.array(["w1 w2 other"])))
    assert hashed == [50_000, 3]
    assert len(own.known) == 50_003  # the end of a text, and "w1" and " other", which were not met


def test_plain_words_go_to_the_model_at_once():
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    plain, own, met = tokenizers.Tokenizer.from_file(path), token_file.Encoder(path), []

    class Told:
        def encode_batch_fast(self, calls, **options):
            met.extend(calls)
            return plain.encode_batch_fast(calls, **options)

    own.tokenizer = Told()
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}é" for i in range(200)]
    texts = [" ".join(words), "x Straße ɏa ȿb ×c d÷e ªf µg don't ñ2 ‘h’ жi", " 二 j\u0301 Çk", "", " l\n m  n"]
    ids, per = own.encode(*flat(pa.array(texts)))
    for t, part in zip(texts, np.split(ids, np.cumsum(per)[:-1]), strict=True):
        assert part.tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]
    told = "".join(met)
    assert not any(w in told for w in (*words[1:], "Straße", "ȿb", "Çk"))
    assert all(w in told for w in ("ɏa", "×c", "d÷e", "ªf", "µg", "don't", "ñ2", "жi", "二", "j\u0301"))


def test_words_are_not_joined_if_a_token_holds_parts_of_two(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    for merges, joined in (([("a", "Ġ"), ("aĠ", "b")], False), ([("Ġ", "b"), ("Ġb", "a")], True)):
        vocabulary = {t: i for i, t in enumerate([*letters, *(a + b for a, b in merges)])}
        tokenizer = tokenizers.Tokenizer(models.BPE(vocabulary, merges))
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        tokenizer.save(path := str(tmp_path / f"{joined}.json"))
        own, text = token_file.Encoder(path), "ca ba bca ba ab"
        assert own.joins_words == joined
        assert own.encode(*flat(pa.array([text])))[0].tolist() == [*tokenizer.encode(text).ids, 2]


def test_lanes_without_ids_and_blocks_of_wide_ids():
    assert token_file.encode_blocks(np.zeros((0, 8), np.int32), np.zeros(0, np.int64)) == []
    ids = np.random.default_rng(4).integers(0, 90_000, (70, 1500)).astype(np.int32)
    ids[:, ::3] %= 7  # places of every width, on both sides of each renewal
    ids[1::2] %= 60_000
    lengths = np.sort(np.random.default_rng(5).integers(0, 1501, 70))[::-1].copy()
    for own, row, n in zip(token_file.decode_blocks(token_file.encode_blocks(ids, lengths)), ids, lengths, strict=True):
        assert own.tolist() == row[:n].tolist()


def test_stretches_of_equal_hash_are_told_apart(monkeypatch):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_file, "hashes_of", lambda strings: np.array([len(s) % 3 for s in strings.to_pylist()], np.int64))
    plain, own = tokenizers.Tokenizer.from_file(path), token_file.Encoder(path)
    texts = ["one two six ten", "", "ten six two one, eleven", "six\none", "", "two eleven twelve"]
    for _ in range(2):
        ids, per = own.encode(*flat(pa.array(texts)))
        for t, part in zip(texts, np.split(ids, np.cumsum(per)[:-1]), strict=True):
            assert part.tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]


def test_large_ids():
    ids = np.array([[70_000, 100_000, 3, 70_000, 100_000, (1 << 24) - 1]])
    assert (token_file.decode_blocks(token_file.encode_blocks(ids, np.array([6])))[0] == ids[0]).all()
    with pytest.raises(ValueError):
        token_file.encode_blocks(np.array([[1 << 24]]), np.array([1]))


def test_documents_that_span_many_reads(spark, tmp_path, monkeypatch):
    """Small blocks and few lanes: documents end in later records than their index stands in."""
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    monkeypatch.setattr(token_file, "BLOCK", 16)
    monkeypatch.setattr(token_file, "LANES", 4)
    path = public.path("byte_bpe_50k.json")
    texts = [" ".join(["word"] * n) for n in (0, 1, 300, 2, 63, 64, 65, 1000, 0, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_file.write_tokens(docs, str(tmp_path / "f"), path, shards=2)
    got = {r["doc_id"]: r["ids"] for r in token_file.read_tokens(spark, str(tmp_path / "f")).collect()}
    plain = tokenizers.Tokenizer.from_file(path)
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        token_file.write_tokens(docs.select(docs.doc_id.cast("string"), "text"), str(tmp_path / "g"), path)


def test_item_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
