"""The training-data operators against brute force, with the cases that every one must take."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainfield.llm import chat_format, common, decontaminate, html_extract, line_dedup, lm_score, metric_join, mixing, near_dup, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fold(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def groups(pairs, ids):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# Shared pieces.


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, pairs):
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(pairs, {i for p in pairs for i in p})
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)}


def test_components_of_a_long_path(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert common.components(e).where("component != 0").count() == 0


def test_byte_text_keeps_texts_apart(spark):
    words = ["é", "É", "ã©", "Ã©", "ß", "ẞ", "İ", "i", "I", "ﬀ", "€", "𝄞", "Ð", "ð", "", None, "À", "à", "ā", "Ā"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(common.byte_text(F.col("t"))).collect()]
    for (a, x), (b, y) in itertools.combinations(zip(words, got, strict=True), 2):
        assert (x == y) == (fold(a or "") == fold(b or "")), (a, b)


def test_bitmap(spark):
    h = spark.createDataFrame([(5,), (-7,), (1 << 62,)], "h long")
    bm = common.bitmap(h, 1 << 14)
    probe = spark.createDataFrame([(5,), (-7,), (1 << 62,), (6,)], "h long").withColumn("bm", bm.scalar())
    assert [r[0] for r in probe.select(common.array_bit(F.col("bm"), F.col("h"), 1 << 14)).collect()] == [True, True, True, False]


# 1: chat formatting.


def test_chat_round_trip(spark):
    t = chat_format.Template()
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\[OUT]\\", "[ROLE]x[/ROLE]", "", None, "a\n</s", "[[INST]]", "<s><s>", "<\\s>", "[/END]" * 3, "x" * 200_000]
    rows = [(1, k, r, x) for k, (r, x) in enumerate(zip(itertools.cycle(["user", "assistant", "tool", "system", None, "[INST]"]), hard, strict=False))]
    got = chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template=t)
    row = got.withColumn("back", chat_format.read_back(F.col("formatted"), t)).first()
    assert [(b.role, b.text) for b in row.back] == [(r or "", x or "") for _, _, r, x in rows]
    assert [b.loss for b in row.back] == [r == "assistant" for _, _, r, _ in rows]
    assert "".join(s.text for s in row.segments) == row.formatted and not row.valid


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<s>/[]INSTOUEDRL\\ é", max_size=25), min_size=1, max_size=4))
def test_escape_is_reversible(spark, texts):
    t = chat_format.Template()
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("e", chat_format.escaped(F.col("t"), t))
    for r in df.withColumn("u", chat_format.unescaped(F.col("e"), t)).collect():
        assert r.u == r.t and not any(m in r.e for m in t.controls())


def test_chat_machine(spark):
    said = {1: "ua", 2: "sua", 3: "au", 4: "uu", 5: "u", 6: "sa", 7: "uaxa"}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(i, k, names[c], "t") for i, s in said.items() for k, c in enumerate(s)]
    got = {r.conv_id: (r.valid, r.first_error) for r in chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 1), 7: (False, 2)}


def test_chat_edges(spark):
    kind = "conv_id long, turn long, role string, text string, formatted int"
    assert chat_format.conversations(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, None, None, None, 1), (1, 0, "user", "b", 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1)]
    got = {r.conv_id: r.n_turns for r in chat_format.conversations(spark.createDataFrame(rows, kind)).collect()}
    assert got == {None: 1, 1: 3}
    with pytest.raises(ValueError):
        chat_format.Template(bos="[INST]x")


# 3: toxicity.


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(0)
    xs = [np.array(sorted({int(a), 2 + int(b), *rng.integers(10, 40, 5).tolist()})) for a, b in rng.integers(0, 2, (1500, 2))]
    y = np.array([float((0 in x) == (2 in x)) for x in xs])
    m = toxicity.train(xs, y, 64)
    at = [np.searchsorted(m.terms, x) for x in xs]
    assert (((m.scores(at) >= 0.5) == (y > 0)).mean()) > 0.95  # no additive weights can do this


def test_pairs_whose_members_are_clean():
    """Documents with a word of each of two kinds are toxic, those with one of them aren't; other words are noise."""
    rng = np.random.default_rng(1)
    xs, y = [], []
    for a, b in rng.random((4000, 2)) < 0.3:
        xs.append(np.array(sorted({*rng.integers(100, 3000, 40).tolist(), *([int(rng.integers(3))] if a else []), *([10 + int(rng.integers(3))] if b else [])})))
        y.append(float(a and b))
    y = np.array(y)
    m = toxicity.train(xs[:3000], y[:3000], 4096)
    at = [np.searchsorted(m.terms, x[np.isin(x, m.terms)]) for x in xs[3000:]]
    assert ((m.scores(at) >= 0.5) == (y[3000:] > 0)).mean() > 0.99


def test_margin_like_brute_force():
    rng = np.random.default_rng(2)
    m = toxicity.FactorizationMachine(64, np.arange(12), 0.3, rng.normal(size=12), rng.normal(size=(12, 3)))
    docs = [np.array(sorted(rng.choice(12, k, replace=False)), np.int64) for k in (0, 1, 2, 5, 12)]
    for x, got in zip(docs, m.scores(docs), strict=True):
        pairs = sum(m.factors[a] @ m.factors[b] for a, b in itertools.combinations(x, 2))
        assert got == pytest.approx(1 / (1 + math.exp(-(0.3 + m.weights[x].sum() + pairs / max(1, len(x))))))


def test_toxicity_held_out():
    # Words of one kind mark the label in part of the documents; others are noise.
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 3000, 60) for _ in range(3000)]
    y = np.array([float(k % 10 == 0) for k in range(3000)])
    xs = [np.unique(np.concatenate([d, [5000 + int(rng.integers(10))]]) if v else d) for d, v in zip(docs, y, strict=True)]
    m = toxicity.train(xs[:2000], y[:2000], 8192)
    at = [np.searchsorted(m.terms, x[np.isin(x, m.terms)]) for x in xs[2000:]]
    assert ((m.scores(at) >= 0.5) == (y[2000:] > 0)).mean() > 0.99


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (2, "word " * 50_000, None), (2, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted != 0").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(50).withColumn("h", toxicity.held_out(F.col("id"))).collect()
    assert [r.h for r in got] == [zlib.crc32(str(r.id).encode()) % 5 == 0 for r in got]


# 4: line dedup.


def brute_lines(rows):
    key = lambda line: fold(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


LINES = st.lists(st.sampled_from(["", " ", "short", "A long line that repeats", "a LONG line that repeats\t", "Élan vital, encore une fois", "élan vital, encore une fois", "another long line here", "\x0b another long line here"]), max_size=6).map("\n".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), LINES)), max_size=8))
def test_lines_like_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_lines int")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.kept_lines(df).collect()]
    assert sorted(got, key=str) == sorted(brute_lines(rows), key=str)


def test_lines_in_three_documents(spark):
    rows = [(i, "this line is shared\nown line number %d" % i) for i in range(3)] + [(3, "another shared line"), (4, "another shared line")]
    got = line_dedup.kept_lines(spark.createDataFrame(rows, DOCS), min_docs=3).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [0, 1, 1, 0, 0]


# 5: secrets.


def brute_spans(t):
    kinds = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
    )
    out = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(kinds) for m in re.finditer(p, t) if len(m[g]) >= n]
    return [(name, a, b) for a, _, name, b in sorted(out)]


SECRETS = st.lists(
    st.sampled_from(["password=", "TOKEN : '", "api_key: ", "apikey='", "é𝄞 ", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN1", "secret", "= ", "x9" * 8, " ", "\n", "deadbeef" * 3, "short", "\""]), max_size=10
).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), SECRETS), max_size=6))
def test_secrets_like_brute_force(spark, texts):
    df = spark.createDataFrame([(k, t, "r", "o") for k, t in enumerate(texts)], DOCS + ", repository string, owner string")
    for r in secrets.secrets(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind != "reuse"] == brute_spans(texts[r.doc_id] or "")


def test_secret_owners(spark):
    live, example = "k3yV4lu3xQzR7tPm", "abc123EXAMPLEtoken9"
    rows = [(0, f"token={live}", "r0", "o0"), (1, f"see {live} here", "r1", "o0"), (2, "nothing", "r1", "o0")] + [(10 + k, f"secret: {example}", f"r{k}", f"o{k}") for k in range(4)]
    got = {r.doc_id: [(s.kind, s.verdict) for s in r.spans] for r in secrets.secrets(spark.createDataFrame(rows, DOCS + ", repository string, owner string")).collect()}
    assert got[0] == [("assign", "live")] and got[1] == [("reuse", "live")] and got[2] == [] and got[10] == [("assign", "example")]
    # Many repositories of one owner make an example too; a live value is found at the end of a path, an option or a sentence.
    wide = [(20 + k, f"token = {live}x", f"q{k}", "o9") for k in range(6)]
    bare = [(30, f"see AWS_KEY={live}", "r1", "o0"), (31, f"https://host.example/{live}", "r1", "o0"), (32, f"it is {live}. And", "r1", "o0"), (33, f"not x{live}", "r1", "o0")]
    rows = [(0, f"token={live}", "r0", "o0"), *wide, *bare]
    got = {r.doc_id: [(s.kind, s.verdict, s.start, s.end) for s in r.spans] for r in secrets.secrets(spark.createDataFrame(rows, DOCS + ", repository string, owner string")).collect()}
    assert got[20] == [("assign", "example", 0, 8 + len(live) + 1)] and got[33] == []
    assert [got[k] for k in (30, 31, 32)] == [[("reuse", "live", a, a + len(live))] for a in (12, 21, 6)]
    none = spark.createDataFrame([(None, f"token={live}", None, None), (None, f"token={live}", None, None)], DOCS + ", repository string, owner string")
    assert [len(r.spans) for r in secrets.secrets(none).collect()] == [1, 1]


# 6: LM scores.


def test_lm_like_brute_force(spark, docs, texts):
    for order in (1, 2, 3):
        got = {r.doc_id: (r.n_words, r.log_score) for r in lm_score.stupid_backoff(docs, order=order, shares=5, chunk_words=4000).collect()}
        words = {i: t.encode().lower().split() for i, t in texts.items()}
        counts = Counter(tuple(w[k : k + n]) for w in words.values() for n in range(1, order + 1) for k in range(len(w) - n + 1))
        total = sum(map(len, words.values()))

        def log(w, k):
            n = min(k + 1, order)
            gram = tuple(w[k - n + 1 : k + 1])
            below = counts[gram[:-1]] if n > 1 else total  # noqa: B023
            return math.log(counts[gram] / below) + (order - n) * math.log(0.4)  # noqa: B023

        for i, w in words.items():
            assert got[i][0] == len(w)
            if w:
                assert got[i][1] == pytest.approx(sum(log(w, k) for k in range(len(w))), rel=1e-9)


def test_lm_leaves_the_scored_document_out(spark, docs, texts):
    extra = {-1: "zyzzyva qwertz", -2: "one", -3: ""}
    rows = texts | extra
    df = spark.createDataFrame(list(rows.items()), DOCS)
    got = {r.doc_id: r.log_score for r in lm_score.stupid_backoff(df, order=3, leave_out=True, shares=5, chunk_words=4000).collect()}
    words = {i: t.encode().lower().split() for i, t in rows.items()}
    grams = lambda w: Counter(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    every = sum((grams(w) for w in words.values()), Counter())
    total = sum(map(len, words.values()))
    levels = Counter()
    for i, w in words.items():
        own, want = grams(w), 0.0
        for k in range(len(w)):
            for n in (3, 2, 1):
                g = tuple(w[k - n + 1 : k + 1])
                if k >= n - 1 and every[g] > own[g]:
                    below = every[g[:-1]] - own[g[:-1]] if n > 1 else total - len(w)
                    want += math.log((every[g] - own[g]) / below) + (3 - n) * math.log(0.4)
                    break
            else:
                n, want = 0, want + 3 * math.log(0.4) - math.log(total - len(w))
            levels[n] += 1
        assert got[i] is None if not w else got[i] == pytest.approx(want, rel=1e-9)
    assert min(levels[n] for n in range(4)) > 0
    one = lm_score.stupid_backoff(df.where("doc_id = -1"), order=3, leave_out=True).collect()
    assert one[0].log_score == pytest.approx(6 * math.log(0.4))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_of_another_table(spark, texts, order):
    rows = dict(list(texts.items())[:40])
    new = {1: " ".join(list(texts.values())[50].split()[:400]), 2: list(texts.values())[3] + " qwertz never seen", 3: "never seen", 4: None}
    df, model = spark.createDataFrame(list(new.items()), DOCS), spark.createDataFrame(list(rows.items()), DOCS)
    got = {r.doc_id: r.log_score for r in lm_score.stupid_backoff(df, model, order=order, shares=3, chunk_words=3000).collect()}
    words = [t.encode().lower().split() for t in rows.values()]
    counts = Counter(tuple(w[k : k + n]) for w in words for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total, levels = sum(map(len, words)), Counter()
    for i, t in new.items():
        w, want = (t or "").encode().lower().split(), 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if counts[g]:
                    want += math.log(counts[g] / (counts[g[:-1]] if n > 1 else total)) + (order - n) * math.log(0.4)
                    break
            else:
                n, want = 0, want + order * math.log(0.4) - math.log(total)
            levels[n] += 1
        assert got[i] is None if not w else got[i] == pytest.approx(want, rel=1e-9)
    assert min(levels[n] for n in range(order + 1)) > 0
    alone = lm_score.stupid_backoff(df.where("doc_id = 3"), model.limit(0), order=order).first()
    assert alone.log_score == pytest.approx(2 * order * math.log(0.4))
    with pytest.raises(ValueError):
        lm_score.stupid_backoff(df, model, leave_out=True)


def test_lm_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "w " * 30_000), (2, "b"), (-(1 << 63), "least")], DOCS).withColumn("DOC_ID_", F.lit(1))
    got = lm_score.stupid_backoff(df).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == [("-9223372036854775808", 1), ("1", 0), ("1", 0), ("2", 1), ("2", 30000), ("None", 2)]
    assert all((r.log_score is None) == (r.n_words == 0) for r in got)
    assert lm_score.stupid_backoff(df.limit(0)).count() == 0


# 7: HTML.


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<article><h1>A &amp; b</h1><p>one  two\nthree", "A & b\none two three"),
        ("<nav><a href=x>home</a></nav><article><p>x<p>y <a href=z>link</a> w</article><footer>c</footer>", "x\ny link w"),
        ("<div class='ad'>buy now</div><article><p>body<script>var t='</p>';</script> text<!-- note --></p><div class=comments><p>hi</p></div></article>", "body text"),
        ("<body class='has-sidebar'><div class='sidebar'>s</div><main><p>kept</p><aside>a</aside><form>f</form></main>", "kept"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>x</p><foot", "x"),
        ("<article><p>a &lt;b&gt; &#233;&nbsp;c</p></article>", "a <b> é c"),
        ("<article><div class='header-wrap'><h1>head</h1><p>first</p></div><p>second</p></article>", "head\nfirst\nsecond"),
        ("<article><header><h1>head</h1></header><p>body of it</p><footer>foot</footer></article><footer>c</footer>", "head\nbody of it"),
        ("<nav>n</nav><div class='legal-analysis'><h1>The case</h1>" + "".join(f"<p>{'word ' * n}</p>" for n in (40, 25, 60)) + "</div><footer>c</footer>", "The case\n" + "\n".join(" ".join(["word"] * n) for n in (40, 25, 60))),
        ("<article><p>kept</p></article><section id='reader-discussion'><p>" + "talk " * 30 + "</p></section>", "kept"),
        ("<article><p>text <span class=ad>buy <span>now</span> it</span> more <em class=note>it</em></p><p>next</p></article>", "text more it\nnext"),
        ("<article><p>open <span class='ad'>never closed</p><p>next</p></article>", "open\nnext"),
        ("<article><div class='cookieNotice'><p>we use</p></div><p>kept</p><ul class='share_list'><li>x</li></ul></article>", "kept"),
    ],
)
def test_pages(page, text):
    assert html_extract.main_text(page, html_extract.trained_tree()) == text


@pytest.mark.parametrize(
    "page,parts",
    [
        ("<article><ul class=comments><li>first<ul><li>reply</li></ul></li><li>second</li><li>third</li></ul><p>end</p></article>", {"first": 1, "reply": 1, "second": 1, "third": 1, "end": 0}),
        ("<article><ul class=menu><li>a<ol><li>b<li>c</ol><li>d</ul><p>end</article>", {"a": 1, "b": 1, "c": 1, "d": 1, "end": 0}),
        ("<article><p>intro<div class=ad><p>advert</p></div><p>body</p></article>", {"intro": 0, "advert": 1, "body": 0}),
        ("<article><p>x<table class=ad><tr><td>a<table><tr><td>b</td></tr></table></td><td>c<tr><td>d</table><p>y</article>", {"x": 0, "a": 1, "b": 1, "c": 1, "d": 1, "y": 0}),
        ("<article><table><tr><td class=ad>a<tr><td>b</td><td class=ad>c<tbody><tr><td>d</table></article>", {"a": 1, "b": 0, "c": 1, "d": 0}),
        ("<article><dl class=ad><dt>a<dd>b<dl><dt>c</dl><dt>d</dl><p>y</article>", {"a": 1, "b": 1, "c": 1, "d": 1, "y": 0}),
    ],
)
def test_nested_elements_stay_in_their_part(page, parts):
    them = html_extract.blocks(page)
    assert {b.text: int(b.part or b.named == 1) for b in them} == parts and all(b.main for b in them)


def test_tree_fits_its_table():
    tree = html_extract.trained_tree()
    them = [html_extract.blocks(p) for p in html_extract.labelled_pages()]
    right = [k == (b.label == "main") for p in them for b, k in zip(p, tree.predict(html_extract.features(p)), strict=True)]
    assert sum(right) / len(right) > 0.98


def test_html_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit(1))
    for r in html_extract.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = [" ".join(__import__("html").unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in want if x)
    assert html_extract.extracted(pages.limit(0)).count() == 0
    assert html_extract.main_text("<div>" * 5000 + "<p" * 5000, html_extract.trained_tree()) == ""


# 8: near-duplicates of texts.


def brute_near(rows, k, percent):
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = groups(links, sets)
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def family(n=40, seed=3):
    """A base, copies of it that differ from each other more than from the base, and half copies."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(150)]
    out = {}
    for i in range(n):
        w = list(base)
        for at in rng.choice(150, 4 if i < 30 else 20, replace=False):
            w[at] = f"x{i}_{at}"
        out[i + 1] = " ".join(w)
    out[1000] = " ".join(base)
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_like_brute_force(spark, texts, words, percent):
    rows = dict(texts) | {10_000 + i: t for i, t in family().items()} | {20_000: "two words", 20_001: "TWO\twords", 20_002: "", 20_003: None, 20_004: "É", 20_005: "é"}
    got = near_dup.near_duplicates(spark.createDataFrame(list(rows.items()), DOCS), words=words, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_near(rows, words, percent)


def test_near_edges(spark):
    rows = [(None, "same text here now"), (5, "same text here now"), (7, "same text here now"), (7, "another text of this kind"), (9, "another text of this kind"), (9, "another text of this kind")]
    got = near_dup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", kept int"), words=3, percent=85).collect()
    assert sorted((str(r.doc_id), r.component_id if r.doc_id else None, r.kept) for r in got) == [("5", 5, True), ("7", 5, False), ("7", 5, False), ("9", 5, False), ("9", 5, False), ("None", None, True)]
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_ids_with_several_texts_keep_the_links_of_each(spark):
    text = lambda x, change=None: " ".join("other" if k == change else f"{x}{k}" for k in range(100))
    rows = [(1, text("a")), (1, text("b")), (2, text("a", 50)), (3, text("b", 50)), (4, text("c")), (5, text("c", 20)), (5, text("d")), (0, text("d", 30)), (6, text("e")), (6, text("e") + " more"), (7, text("e", 99))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), words=3, percent=85).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 0, False), (5, 0, False), (0, 0, True), (6, 6, True), (7, 6, False)}


def test_groups_for():
    for s, rows in ((0.85, 3), (0.8, 3), (0.9, 2)):
        m, p = near_dup.groups_for(s, rows, 1e-5), s**rows
        assert (1 - p) ** m + m * p * (1 - p) ** (m - 1) <= 1e-5


# 9: decontamination.


def brute_contamination(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
    wins = [(str(i), tuple(w[k : k + min(13, len(w))])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 12))]
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for name, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found.add(name)
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_contamination_like_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda n, v=60: [f"w{k}" for k in rng.integers(0, v, n)]
    items = [(k, " ".join(word(n))) for k, n in enumerate((13, 14, 20, 40, 12, 5, 1, 0, 30))] + [(99, None), (50, "One, TWO"), (51, "a a a a a a a a a a a a a a a a a")]
    rows = []
    for k in range(60):
        w = word(int(rng.integers(0, 120)))
        src = (items[int(rng.integers(0, 9))][1] or "").split()
        if src and k % 2:
            a = int(rng.integers(0, len(src)))
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = src[a : a + int(rng.integers(1, 30))]
        rows.append((k, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "x one-two y"), (103, "a " * 40), (104, "a " * 12), (None, "one two"), (102, "x one-two y"), (105, "Été " * 20)]
    items.append((52, "été " * 13))
    got = decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()], key=str) == sorted(brute_contamination(rows, items), key=str)


def test_contamination_edges(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.contamination(docs, none).first()
    assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (2, 0, [], False)
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(None, "a")], "item_id long, text string")).count() == 0


# 10: near-duplicates of vectors.


def brute_vectors(rows, cosine):
    fine = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for (a, x, l), (b, y, m) in itertools.combinations(fine, 2) if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine]
    comp = groups(links, [r[0] for r in rows if r[0] is not None])
    n = Counter(i for p in links for i in p)
    return {i: (n[i], c, c == i) for i, c in comp.items()}


@pytest.mark.parametrize("block,cosine", [(2048, 0.98), (7, 0.9)])
def test_vectors_like_brute_force(spark, block, cosine):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.3])).tolist(), int(i % 3)) for i in range(240)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, [2 * x for x in rows[0][1]], 0), (303, None, 0), (304, [0.0] * 16, 0), (305, [math.nan] * 16, 0), (306, rows[0][1], None), (307, [], 0), (308, [1.0], 0), (309, [2.0], 0), (310, [math.inf] + [1.0] * 15, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, kept int")
    exact = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(df, cosine=cosine, block=block).collect()}
    assert got == brute_vectors(exact, cosine)


def test_vectors_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert metric_join.near_vectors(spark.createDataFrame([], kind)).count() == 0
    got = metric_join.near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, [None], 1)], kind)).collect()
    assert [(r.n_links, r.kept) for r in got] == [(0, True)] * 2
    some = metric_join.near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (2, [1.0], 1)], kind)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in some) == [("1", 1, True), ("2", 1, False), ("None", 0, True)]


# 2: mixing.


def test_raking_meets_its_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"s{i % 5}", f"l{int(rng.integers(3))}", f"t{int(rng.integers(4))}", int(rng.integers(1, 500))) for i in range(600)] + [(None, None, "l0", "t0", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens int")
    share = lambda d: spark.createDataFrame([(f"={k}", v) for k, v in d.items()] + [("null", 0.01)], "value string, share double")
    targets = {"source": share({f"s{k}": k + 1.0 for k in range(5)}), "lang": share({"l0": 0.5, "l1": 0.3, "l2": 0.2, "none": 9.0}), "topic": share(dict.fromkeys(("t0", "t1", "t2", "t3"), 1.0))}
    got = mixing.mixed(df, list(targets), "tokens", targets).toPandas()
    got["w"] = got["tokens"].fillna(1).clip(lower=1) * got["weight"]
    for d, t in (("lang", {"l0": 0.5, "l1": 0.3, "l2": 0.2}), ("topic", dict.fromkeys(("t0", "t1", "t2", "t3"), 0.25))):
        by = got.groupby(d)["w"].sum() / got["w"].sum()
        assert all(by[k] == pytest.approx(v, abs=2e-3) for k, v in t.items())
    assert got["probability"].between(0, 1).all() and got["probability"].max() == pytest.approx(1)
    assert len(got) == 601 and mixing.mixed(df, list(targets), "tokens", targets).where("selected").count() == got["selected"].sum()


def brute_raking(cells, targets, size, cap, rounds=400):
    """Iterative proportional fitting by loops; with `cap` no cell holds more than its tokens."""
    w = {c: n * size / sum(cells.values()) for c, n in cells.items()} if not cap else dict(cap)
    held = lambda c: min(w[c], cells[c]) if cap else w[c]
    for _ in range(rounds):
        for k, t in enumerate(targets):
            for v, share in t.items():
                s = sum(held(c) for c in w if c[k] == v)
                for c in w:
                    if c[k] == v:
                        w[c] *= share * size / s if s else 0
    return {c: held(c) for c in w}


def test_raking_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{int(rng.integers(3))}", f"l{int(rng.integers(2))}", int(rng.integers(50, 200))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens int")
    targets = [{"s0": 0.5, "s1": 0.3, "s2": 0.2}, {"l0": 0.6, "l1": 0.4}]
    share = lambda t: spark.createDataFrame([(f"={k}", v) for k, v in t.items()], "value string, share double")
    got = mixing.mixed(df, ["source", "lang"], "tokens", {"source": share(targets[0]), "lang": share(targets[1])}, rate=0.4).toPandas()
    cells = Counter()
    for _, a, b, n in rows:
        cells[a, b] += n
    want = brute_raking(cells, targets, sum(cells.values()), None)
    sample = brute_raking(cells, targets, 0.4 * sum(cells.values()), {c: 0.4 * w for c, w in want.items()})
    for (a, b), own in got.groupby(["source", "lang"]):
        assert own["weight"].iloc[0] == pytest.approx(want[a, b] / cells[a, b], rel=1e-4)
        assert own["probability"].iloc[0] == pytest.approx(sample[a, b] / cells[a, b], rel=1e-4)
    assert got["gap"].max() < 1e-5 and got["gap"].nunique() == 1


def test_targets_for_some_values_and_targets_that_cannot_be_met(spark):
    rows = [(i, f"s{i % 4}", "l0" if i % 4 < 2 else "l1", 100) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens int")
    share = lambda t: spark.createDataFrame(list(t.items()), "value string, share double")
    got = mixing.mixed(df, ["source"], "tokens", {"source": share({"=s0": 0.4, None: 0.6})}, rate=0.2).toPandas()
    by = (got["tokens"] * got["probability"]).groupby(got["source"]).sum()
    assert (by / by.sum()).round(4).to_dict() == {"s0": 0.4, "s1": 0.2, "s2": 0.2, "s3": 0.2}
    # Sources fix the languages, at other shares than those asked for: the gap says so.
    both = {"source": share({f"=s{k}": 0.25 for k in range(4)}), "lang": share({"=l0": 0.9, "=l1": 0.1})}
    assert mixing.mixed(df, ["source", "lang"], "tokens", both, rate=0.2).first().gap > 0.1


def test_mixing_edges(spark):
    kind = "doc_id long, source string, tokens int, weight int"
    assert mixing.mixed(spark.createDataFrame([], kind), ["source"], "tokens").count() == 0
    got = mixing.mixed(spark.createDataFrame([(1, None, 0, 1), (1, None, 0, 1)], kind), ["source"], "tokens").collect()
    assert [(r.weight, r.probability, r.selected) for r in got] == [(1.0, 1.0, True)] * 2


def test_a_tiny_cell_does_not_set_the_size(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, f"s{min(i % 7, 3)}", f"l{int(rng.integers(3))}", int(rng.integers(100, 300))) for i in range(2000)]
    kind = "doc_id long, source string, lang string, tokens int"
    mix = lambda r, **k: mixing.mixed(spark.createDataFrame(r, kind), ["source", "lang"], "tokens", **k).toPandas()
    kept = lambda g: (g["tokens"] * g["probability"]).sum() / g["tokens"].sum()
    for rate in (None, 0.6):
        got, more = mix(rows, rate=rate), mix([*rows, (-1, None, None, 3)], rate=rate)
        assert kept(got) == pytest.approx(rate or kept(got), abs=1e-3) and kept(more) == pytest.approx(kept(got), abs=2e-3) and kept(got) > 0.55
        assert more.set_index("doc_id")["probability"][-1] == 1 and more["probability"].between(0, 1).all()
    t = got.groupby("source")["tokens"].sum() ** 0.8
    held = (got["tokens"] * got["probability"]).groupby(got["source"]).sum()
    assert (held / held.sum() - t / t.sum()).abs().max() < 2e-3
    # Tables of many cells are raked by joins, to the same end.
    monkeypatch.setattr(mixing, "SMALL_CELLS", 0)
    again = mix(rows, rate=0.6).set_index("doc_id")["probability"]
    assert np.allclose(again.sort_index(), got.set_index("doc_id")["probability"].sort_index(), rtol=1e-6)


# Columns whose names clash, have dots, or differ from made ones in case only.


def test_clashing_columns(spark):
    kind = "doc_id long, text string, Score double, HELD_OUT int, N_LINES int, Weight double, Gap int, _d0 int, `a.b` int, tokens int, source string"
    docs = spark.createDataFrame([(1, "a line that is long\nx", 1.0, 1, 1, 1.0, 1, 1, 7, 3, "s")], kind)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    page = spark.createDataFrame([(1, "<article><p>x</p></article>", "old", 7)], "page_id long, html string, TEXT string, `a.b` int")
    for got, made in (
        (toxicity.toxicity(docs, labels), {"score", "held_out", "predicted"}),
        (line_dedup.kept_lines(docs), {"n_lines", "n_dropped"}),
        (mixing.mixed(docs, ["source"], "tokens"), {"weight", "probability", "gap", "selected"}),
        (html_extract.extracted(page), {"text"}),
    ):
        names = [c.lower() for c in got.columns]
        assert len(set(names)) == len(names) and made <= set(got.columns)
        assert got.first()["a.b"] == 7
    assert html_extract.extracted(page).first().text == "x"


# Queries and pipeline.


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark", "labels", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_stages_like_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    at = common.cut(stages["toxicity"](spark, docs, SF))
    kept = {r.doc_id for r in queries.op3_toxicity(spark, SF).where("predicted = 0").collect()}
    assert {r.doc_id for r in at.collect()} == kept and at.columns == docs.columns
    rows = {r.doc_id: r.text for r in at.collect()}
    at = common.cut(stages["line_dedup"](spark, at, SF))
    want = {i: t for i, _, _, t in brute_lines(list(rows.items()))}
    assert {r.doc_id: (r.text, r.n_chars) for r in at.collect()} == {i: (t, len(t)) for i, t in want.items()}
    at = common.cut(stages["near_dedup"](spark, at, SF))
    want = {i: t for i, t in want.items() if brute_near(want, 5, 80)[i][2]} if len(want) < 2 else {i: want[i] for i, (_, _, k) in brute_near(want, 5, 80).items() if k}
    assert {r.doc_id: r.text for r in at.collect()} == want
    at = common.cut(stages["decontamination"](spark, at, SF))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i for i, *_, bad in brute_contamination(list(want.items()), items) if not bad}
    assert {r.doc_id for r in at.collect()} == want and at.columns == docs.columns
    # Empty tables, null ids and further columns.
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (None, "one two three", None, None, None, 2)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns and got.count() == 2, name
    last = stages["mixing"](spark, at, SF)
    ids = [r.doc_id for r in last.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= want and len(ids) > 0.2 * len(want)
