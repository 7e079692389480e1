"""Token counts, URL filter, language ID, toxicity and quality rules."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import tiktoken_counts
from support import same_rows
from tallyweave.llm import langid, quality, registry, tokens, toxicity, urls
from tallyweave.llm.words import mix

MODEL = registry.tokenizer_path("piece_bpe_32k.model")
FILES = ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"]


@pytest.mark.parametrize("name", ["op3_url_filter", "op6_quality_rules"])
def test_queries_match_sql(spark, sf_dir, duck, name):
    same_rows(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])


# token counts


def library_counts(name, texts):
    path = registry.tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    return tiktoken_counts(path, texts)


@pytest.mark.parametrize("name", FILES)
def test_counts_are_the_library_s(spark, documents, odd, name):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        texts = [r.text or "" for r in rows]
        want = sorted((repr(r.doc_id), len(t.encode()), int(n)) for r, t, n in zip(rows, texts, library_counts(name, texts), strict=True))
        got = tokens.token_counts(df, registry.tokenizer_path(name)).collect()
        assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_cuts_are_safe(monkeypatch, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert tokens.sentencepiece_splits(model)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 64)
    texts = [r.text for r in documents.select("text").limit(150).collect()]
    texts += ["a  b " * 60, "word" * 200, "x <s> y </s> z " * 30, "tab\tnew\nline " * 40, "▁ odd ▁▁ marks ▁ " * 20, " lead and trail ".rjust(200), "é ü ß 中 文 " * 40, "1 2 3 . , ! " * 30]
    assert tokens.count_tokens(pa.array(texts), MODEL).tolist() == [len(model.encode(t)) for t in texts]
    assert len(tokens.cut_text(("word " * 100).encode(), 64)) > 5 and tokens.cut_text(b"x" * 500, 64) == [b"x" * 500]


def test_bytes_that_are_no_utf8(spark):
    """Such texts are read as with replacement characters by token counts, language ID and toxicity."""
    raw = [b"ok text of words", b"bad \xff\xfe bytes \xc3", b"\x80", b"fine \xc3\xa9 end", None]
    docs = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(raw)], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text", "'en' as lang")
    texts = ["" if r is None else r.decode(errors="replace") for r in raw]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, MODEL).collect()}
    assert got == {k: (len(r or b""), n) for (k, r), n in zip(enumerate(raw), library_counts("piece_bpe_32k.model", texts), strict=True)}
    model = langid.fit(docs)
    assert [r.lang_pred for r in langid.predict(docs, model).orderBy("doc_id").collect()] == ["en", "en", "und", "en", "und"]
    known = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, toxic int"))
    assert toxicity.score(docs, known).count() == 5


def plain_language_scores(text, langs, logs, buckets):
    """Log-likelihoods by plain Python over the hashed n-grams of one text, tempered as documented."""
    kept = re.sub(r"\s+", " ", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text))
    total, n = np.zeros(len(langs)), 0
    for k in (1, 2, 3):
        for i in range(len(kept) - k + 1):
            gram = kept[i : i + k]
            if not gram.strip():
                continue
            h = 0
            for c in gram:
                h = (h * 0x01000193 + (0 if c == " " else ord(c)) + 1) & 0xFFFFFFFF
            h = (h * 0x9E3779B1 + k - 1) & 0xFFFFFFFF
            total += logs[(((h ^ (h >> 15)) * 0x85EBCA6B & 0xFFFFFFFF) >> 8) % buckets].astype(np.float64)
            n += 1
    total *= min(n, langid.EVIDENCE) / max(n, 1)
    odds = np.exp(total - total.max())
    return langs[int(total.argmax())], float(odds.max() / odds.sum())


def test_language_scores_are_plain_naive_bayes(documents):
    model = langid.fit(documents.filter(~langid.held_out()))
    texts = [r.text for r in documents.select("text").limit(60).collect()]
    names, scores = model.score(pa.array(texts))
    for text, name, score in zip(texts, names, scores.tolist(), strict=True):
        if any(c.isalpha() for c in text or ""):
            want = plain_language_scores(text, model.langs, model.logs, len(model.logs))
            assert name == want[0] and abs(score - want[1]) < 1e-6


def test_token_counts_of_an_empty_table(empty):
    assert tokens.token_counts(empty, MODEL).count() == 0


# URLs


def plain_url(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [r for r in registry.URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if rules:
        what, name, start = max(rules, key=lambda r: len(r[1] + r[2]))
        return host, path, name + start, what
    parts = host.split(".")
    forms = {".".join(parts[k:]) + p for k in range(len(parts)) for p in (path, path[:1])} if host else set()
    return host, path, None, "block" if forms & listed else "allow"


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://A.Example.NET/EN/x", "http://example.net/en/", "http://example.net/en", "http://notexample.net/en/", "https://x.com?u=http://y.net/", "https://x.org#/fr/", "ftp://x.y.org/fr/a?b#c",
    "http://spam-farm.example.com/a/b", "http://www.SPAM-farm.example.com/", "http://spam-farm.example.com", "http://xspam-farm.example.com/", "http://one.com/page?q", "http://one.com/other", "a://b://c/d", "http://é.com/ü", "x\n://one.com/page", "http://net/",
]


def test_url_verdicts(spark):
    listed = ["spam-farm.example.com/", "one.com/page", None, "one.com/page", "", *(f"filler{k}.com/" for k in range(500))]
    df = spark.createDataFrame([(k % 20 if k != 5 else None, u, "x", "y") for k, u in enumerate(ODD_URLS * 2)], "page_id long, url string, host string, rule string")
    rows = urls.filter_urls(df, spark.createDataFrame([(x,) for x in listed], "listed string"), registry.URL_RULES).collect()
    want = sorted(map(repr, (plain_url(u, set(filter(None, listed))) for u in ODD_URLS * 2)))
    assert sorted(repr((r.host, r.path, r.rule, r.verdict)) for r in rows) == want


def canonical_form(host, path):
    """Host and path as a list is compared with them, by plain Python."""
    host = re.sub(r"\.+$", "", re.sub(":[0-9]*$", "", host.rpartition("@")[2]))
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~":
        path = re.sub(f"%{ord(c):02x}", c, path, flags=re.I)
    return host, re.sub("%[0-9A-Fa-f]{2}", lambda m: m[0].upper(), path) or "/"


SPELLINGS = [
    "http://free-bets.example.com", "http://free-bets.example.com?x=1", "http://free-bets.example.com/", "http://free-bets.example.com:80/a", "http://free-bets.example.com:8080", "http://u:p@free-bets.example.com/", "http://www.free-bets.example.com./x",
    "http://one.com/%70age", "http://one.com/p%61ge?q", "http://one.com/page", "http://one.com/page%2fx", "http://one.com/page%2Fx", "http://one.com./page", "http://one.com/", "http://two.com/%7euser", "http://two.com/~user", "http://:80/", "http://@/", "http://.../", None, "x",
]


def test_urls_in_canonical_form(spark):
    listed = ["HTTP://Free-Bets.example.com:80", "one.com/%70age", "user@one.com/page%2fx#f", "https://two.com./%7Euser?q", "", None, "://", "/path"]
    entries = set()
    for entry in listed:
        if entry:
            host, path, *_ = plain_url(entry if "://" in entry else "x://" + entry, set())
            host, path = canonical_form(host, path)
            entries |= {host + path} if host else set()
    df = spark.createDataFrame([(k, u) for k, u in enumerate(SPELLINGS + [u for u in ODD_URLS if u != "x\n://one.com/page"])], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, spark.createDataFrame([(x,) for x in listed], "listed string"), registry.URL_RULES, canonical=True).collect()}
    for r in df.collect():
        host, path, rule, verdict = plain_url(r.url, set())
        if rule is None:
            name, way = canonical_form(host, path)
            parts = name.split(".")
            verdict = "block" if name and {".".join(parts[k:]) + p for k in range(len(parts)) for p in (way, way[:1])} & entries else "allow"
        assert got[r.page_id] == (host, path, rule, verdict), r.url


def test_spellings_match_sql(spark, tmp_path):
    """The registered query and its SQL agree on spellings that the tables do not hold."""
    import duckdb

    rows = [(k, u) for k, u in enumerate(u for u in SPELLINGS if u is None or "one.com" not in u)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same_rows(registry.op3(spark, str(tmp_path)), con, registry.OP3_SQL)


def test_long_urls_take_no_long_time(spark):
    long = ["http://" + "a." * 500_000 + "com/x", "http://h.com/" + "%61" * 300_000, "x" * 1_000_000, "http://" + "u@" * 300_000, "http://h" + "." * 500_000]
    df = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    listed = spark.createDataFrame([("com/x",), ("h.com/y",)], "listed string")
    began = time.monotonic()
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, listed, registry.URL_RULES, canonical=True).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "allow"} and time.monotonic() - began < 60


def test_empty_url_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "listed string")
    assert urls.filter_urls(pages, none).collect()[0].verdict == "allow"
    assert urls.filter_urls(pages.limit(0), none, registry.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(pages, none, [("block", "a", "/")] * 500)


# language ID


def test_languages_of_held_out_documents(spark, sf_dir, documents):
    out = registry.op9(spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == documents.count() and len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_ngrams_are_those_of_plain_text():
    texts = ["Ab, c1d", "", "¿Ñu?", "a", "  x  y  "]
    column = pa.array(texts)
    from tallyweave.llm.runtime import text_slices

    (_, _, data, at), *_ = text_slices(column)
    orders, letters = langid.ngram_buckets(data, at)
    plain = [re.sub(r"[^a-zñ]+", " ", t.lower()) for t in texts]
    for k, (found, first) in enumerate(orders, 1):
        grams = [[t[i : i + k] for i in range(len(t) - k + 1) if t[i : i + k].strip()] for t in plain]
        assert np.diff(first).tolist() == [len(g) for g in grams]
        buckets = dict(zip([x for g in grams for x in g], found.tolist(), strict=True))
        assert [buckets[x] for g in grams for x in g] == found.tolist()
    assert letters.tolist() == [True, False, True, True, True]


def test_odd_texts_have_a_language(spark, odd, empty):
    model = langid.fit(odd)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model).collect()]
    assert all((lang == "und") == (i in (1, 2, 3, 10) or i is None and score == 0) for i, lang, score in got)
    nothing = langid.fit(empty)
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, nothing).collect()} == {("und", 0.0)}
    assert langid.predict(empty, model).count() == 0
    assert langid.predict(odd, model).columns[: len(odd.columns)] == odd.columns


def test_rare_languages_are_in_the_sample(spark):
    rows = [(k, f"common words of a large language {k}", "xx" if k % 2 else "yy") for k in range(3000)] + [(10_000 + k, f"seldom speech {k}", f"r{k}") for k in range(8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=100)
    assert model.langs == sorted({"xx", "yy", *(f"r{k}" for k in range(8))})


# toxicity


def test_toxicity_of_held_out_documents(spark):
    out = registry.op4(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic = [r.predicted for r in out if r.toxic == 1]
    clean = [r.predicted for r in out if r.toxic == 0]
    assert len(toxic) > 30 and np.mean(toxic) > 0.8 and np.mean(clean) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_logistic_weights_separate():
    x = np.array([[1.0, 0.5], [0.2, 2.0], [-1.0, 3.0], [0.3, -1.0]])
    y = np.array([0.0, 1.0, 1.0, 0.0])
    w = toxicity._logistic(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0.5)).all()


def test_words_count_their_predecessors_once(spark):
    """Copies and near copies add nothing to a word's count; new places do."""
    copies = [("one two vile three four five six", 1)] * 30
    places = [(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} spread end", 0) for k in range(40)]
    got = {r.w: (r.n0, r.n1) for r in toxicity.word_counts(spark.createDataFrame(copies + places, "t string, y int")).collect()}
    assert got["vile"] == (0, 1) and 30 <= got["spread"][0] <= 50 and got["spread"][1] == 0


def test_predecessors_are_counted_without_a_bound(spark):
    name = lambda k: "p" + "".join(chr(97 + int(c)) for c in str(k))
    rows = [(" ".join(f"{name(k)} often" for k in range(n, n + 100)), y) for y, many in ((0, 3000), (1, 700)) for n in range(0, many, 100)]
    rows += [("often", 0), ("often", 1), (" ".join(f"{name(k)} once" for k in range(50)), 0)] * 3
    got = {r.w: (r.n0, r.n1) for r in toxicity.word_counts(spark.createDataFrame(rows, "t string, y int")).collect()}
    assert got["often"] == (3001, 701) and got["once"] == (50, 0)


class PlainKneserNey:
    """Class-conditional interpolated Kneser-Ney over strings, with the shared backoff, from (word, n0, n1) rows."""

    def __init__(self, counts, order=toxicity.ORDER, shared=toxicity.SHARED, discount=toxicity.DISCOUNT):
        self.order, self.shared, self.discount = order, shared, discount
        grams = [[defaultdict(Counter) for _ in range(3)] for _ in range(order)]
        for word, n0, n1 in counts:
            marked = f"^{word}$"
            for end in range(2, len(marked) + 1):
                for k in range(1, order + 1):
                    start = max(0, end - k)
                    raw = k == order or start == 0
                    for y, n in ((0, n0), (1, n1), (2, n0 + n1)):
                        if n:
                            grams[k - 1][y][marked[start:end]]["" if raw else marked[start - 1]] += n
        self.counts = [[{g: sum(c.values()) if "" in c else len(c) for g, c in by.items()} for by in each] for each in grams]
        self.chars = sorted({g for each in self.counts[0] for g in each})

    def p(self, y, char, context, k):
        if k == 0:
            return 1 / (len(self.chars) + 1)
        if context is not None:
            h = context[max(0, len(context) - k + 1) :]
        own = {g[-1]: n for g, n in self.counts[k - 1][y].items() if g[:-1] == h}
        total, more = sum(own.values()), self.shared if y < 2 else 0
        if not total + more:
            return self.p(y, char, context, k - 1)
        out = max(own.get(char, 0) - self.discount, 0) + self.discount * len(own) * self.p(y, char, context, k - 1)
        return (out + (more * self.p(2, char, context, k) if more else 0)) / (total + more)

    def odds(self, word):
        marked, total = f"^{word}$", 0.0
        for end in range(1, len(marked)):
            total += np.log(self.p(1, marked[end], marked[:end], self.order) / self.p(0, marked[end], marked[:end], self.order))
        return np.log1p(toxicity.TOXIC_SHARE * np.expm1(total))


SMALL = [("common", 50, 45), ("commons", 3, 0), ("vile", 0, 60), ("viler", 0, 2), ("evil", 1, 9), ("rareone", 1, 0), ("raretwo", 0, 1), ("on", 7, 7), ("a", 2, 1), ("éà", 1, 1)]


def model_of(spark, counts):
    """The tables of a model for words with given counts."""
    rows = spark.createDataFrame(counts, "w string, n0 long, n1 long")
    real = toxicity.word_counts
    try:
        toxicity.word_counts = lambda labelled: rows
        none = spark.createDataFrame([], "doc_id long, text string")
        return toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    finally:
        toxicity.word_counts = real


def test_model_is_plain_kneser_ney(spark):
    """Odds of known and unknown words agree with plain Python; P of all characters behind a context sums to 1."""
    model, plain = model_of(spark, SMALL), PlainKneserNey(SMALL)
    words = [w for w, *_ in SMALL] + ["villain", "commonly", "zzz", "rarevile", "onon", "éa"]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    got = model.word_odds(codes, ends - [len(w) for w in words], ends)
    assert np.abs(got - [plain.odds(w) for w in words]).max() < 1e-6  # tables are float32
    for context in ("^", "^co", "^vil", "^comm", "^zz", "^rareon"):
        for y in (0, 1, 2):
            total = sum(plain.p(y, c, context, plain.order) for c in plain.chars) + plain.p(y, "?", context, plain.order)
            assert abs(total - 1) < 1e-12


def test_ngrams_are_kept_apart(spark):
    """Many n-grams, each with its own counts and found in its place; counts below the highest order are of different characters before."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(60_000)})
    counts = [(w, k % 3, k % 2) for k, w in enumerate(words) if k % 3 or k % 2]
    rows = toxicity.gram_counts(spark.createDataFrame(counts, "w string, n0 long, n1 long")).toPandas()
    plain = PlainKneserNey(counts)
    for k in range(toxicity.ORDER):
        mine = rows[rows.k == k]
        want = sorted((plain.counts[k][0].get(g, 0), plain.counts[k][1].get(g, 0), n) for g, n in plain.counts[k][2].items())
        assert sorted(zip(mine.c0, mine.c1, mine.c, strict=True)) == want
    codes = mine.gram.to_numpy().view(np.uint64)
    assert len(codes) > 1 << 18
    codes = codes[np.argsort(mix(codes))]
    table = toxicity.Table(mix(codes))
    assert (table.find(codes) == np.arange(len(codes))).all() and (table.find(codes + np.uint64(1))[~np.isin(codes + np.uint64(1), codes)] == len(codes)).all()
    assert toxicity.Table(codes[:0]).find(codes[:9]).tolist() == [0] * 9


def test_rare_words_have_almost_one_probability_in_both_classes(spark):
    model = model_of(spark, [("common", 50, 50), ("vile", 0, 60), ("rareone", 1, 0), ("raretwo", 0, 1)])
    words = ["vile", "rareone", "raretwo", "unknown"]
    ends = np.cumsum([len(w) for w in words])
    odds = model.word_odds(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), ends - [len(w) for w in words], ends)
    assert odds[0] > 10 * np.abs(odds[1:]).max()


def test_toxicity_of_odd_texts(spark, odd, empty):
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choice(["plain", "words", "of", "all", "kinds", *(["vileword", "vilething"] if k % 3 == 0 else [])]) for _ in range(30))) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = toxicity.score(docs, model).filter(toxicity.held_out()).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in held) and len(held) > 50
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, blank).collect()} == {0.5}


# quality rules


def plain_quality(text):
    text = text or ""
    w = plain = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(plain), sum(map(len, plain)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, empty):
    texts = ["a b c d e a b c d e", "x x x x x x x x x x x", "one\n\none\n \none.", "p q r s t u p q r s t v w. " * 3, "#|<>&", "\t", "a b c d e f g a b c d e z c d e f g"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for frame in (df, odd):
        rows = frame.select("doc_id", "text").collect()
        got = quality.assess(frame).collect()
        want = sorted(repr((r.doc_id, *plain_quality(r.text))) for r in rows)
        assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.assess(empty).count() == 0


def test_lines_are_judged_first(spark):
    good = "This is a sentence of more than enough words to be kept by all rules."
    lines = [good, "Home | News | Sport | More", "All rights reserved. Terms of use.", "no mark at all"]
    other = "Another line says quite different things about something else, and then ends."
    text = "\n".join([other, *lines])
    df = spark.createDataFrame([(1, text), (2, "\n".join(lines[1:] * 6 + [good])), (3, good)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert got[1].cleaned == other + "\n" + good and got[1].kept and got[3].kept and not got[2].kept


def test_quality_is_native(spark, sf_dir):
    plan = registry.op6(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
