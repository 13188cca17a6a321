"""The ten operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from loomspark.llm import cells, chat, fingerprints, html_text, langid, mixing, near_dedup, packing, perplexity, quality, suffix_dedup
from loomspark.llm.components import components
from loomspark.llm.common import list_bytes, materialise
from loomspark.llm.suffix_array import suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, "a", "en", "a", 1),
    (3, "a", "en", "a", 1),
    (4, " \n\t ", "de", "b", 5),
    (None, "no id here at all", "en", "a", 17),
    (5, "word " * 30000, "en", None, 150000),
    (6, "ünï ©ode\x00 ␛<|im_end|> " * 40, "fr", "b", 9),
]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns named like the operators' own."""
    for c in ("score", "kept", "row", "n", "part", "pos", "id_", "v", "q", "u", "predicted", "fingerprint", "loom_id", "loom_rid", "loom_s", "LOOM_e", "loom_copies"):
        df = df.withColumn(c, F.lit("x"))
    return df


OPERATORS = {
    "perplexity": lambda d: perplexity.perplexity_rules(d),
    "suffix": lambda d: suffix_dedup.removal_digest(d, 400),
    "suffix_text": lambda d: suffix_dedup.remove_repeats(d, 100),
    "fingerprints": lambda d: fingerprints.edited_pairs(d),
    "near": lambda d: near_dedup.near_duplicates(d),
    "packing": lambda d: packing.pack_documents(d, tokenizer()),
    "langid": lambda d: langid.identify(d, langid.train(langid.learning_sample(d))),
    "mixing": lambda d: mixing.mix_sources(d),
    "quality": lambda d: quality.score_documents(d, quality.train(quality.learning_sample(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))))),
}


#: These keep all columns of the documents.
STAGES = {
    "remove_repeats": (lambda d: suffix_dedup.remove_repeats(d, 100, 51), False),
    "keep_one": (lambda d: near_dedup.keep_one(d), True),
    "keep_good": (lambda d: quality.keep_good(d, quality.train([]), 0.5), False),
    "mix_documents": (lambda d: mixing.mix_documents(d), None),
    "repeat_documents": (lambda d: mixing.repeat_documents(d, mixing.mix_sources(d)), None),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    """Nulls, repeated rows and clashing columns through what changes documents; then no rows."""
    run, once = STAGES[name]
    rows = clashing(documents(spark, ODD))
    got = run(rows)
    assert got.columns == rows.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    if once is not None:  # all rows stay, or equal ones become one
        assert ids == sorted((x is None, x or 0) for x in ({r[0] for r in ODD} if once else [r[0] for r in ODD]))
    assert run(documents(spark, [])).collect() == []


def test_pages_edge_cases(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (2, "v", "<p>long " * 20000, "x"), (3, "w", "<article><p>a &amp; b</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text[:20], r.n_chars) for r in html_text.extract_pages(pages).collect()))
    assert got == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "long\nlong\nlong\nlong\n", 99999), (3, "a & b", 5)]
    assert html_text.extract_pages(pages.limit(0)).collect() == []


def test_no_edges_and_no_labels(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(docs, quality.train(quality.learning_sample(docs, none))).collect()} == {0.5}


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases(spark, name):
    """Nulls, empty and long texts, repeated rows and clashing extra columns; then no rows."""
    got = OPERATORS[name](clashing(documents(spark, ODD))).collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {r[0] for r in ODD}
    else:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ODD)
    assert OPERATORS[name](documents(spark, [])).collect() == []


# --- 1 ---


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hit, seen = [False] * len(words), Counter(zip(words, words[1:], words[2:]))
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    before, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(hit)


def test_base_counts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    texts = [r.text for r in rows] + [None, "", "a a a a a", "x\ny\nx\n\n\x0b\nx", "\x85b  c", "", "a\n", "\na", "b c b c b c\nb c", ""]
    raw, offs = list_bytes([(t or "").encode() for t in texts])
    assert perplexity.base_counts(raw, offs).tolist() == [list(slow_counts(t)) for t in texts]


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over byte 5-grams of one language, by definition."""
    raw = Counter()
    for t in texts:
        b = bytes(4) + t.encode()
        raw.update(b[i : i + 5] for i in range(len(b) - 4))
    adj = {5: dict(raw)}
    for m in (4, 3, 2, 1):
        total, cont = Counter(), Counter()
        full = Counter()
        for g, c in raw.items():
            full[g[5 - m :]] += c
        for g in {g[5 - m - 1 :] for g in raw}:
            cont[g[1:]] += 1
        adj[m] = {g: (full[g] if g[0] == 0 else c) for g, c in cont.items()}
    disc, ctx = {}, {}
    for m, t in adj.items():
        n = Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] and n[3] else None
        disc[m] = [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.05) if y else 0.5 * k for k in (1, 2, 3)]
        s = defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            s[g[:-1]][0] += c
            s[g[:-1]][1] += min(disc[m][min(c, 3) - 1], c)
        ctx[m] = s

    def p(g):
        if not g:
            return 1 / 256
        m, (total, mass) = len(g), ctx[len(g)].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        c = adj[m].get(g, 0)
        return (c - min(disc[m][min(c, 3) - 1], c) if c else 0) / total + mass / total * p(g[1:])

    return p


def test_model_equals_definition(spark):
    """Each text by the model of the other fold, n-grams that this one lacks included; any number of shards."""
    random.seed(3)
    texts = ["".join(random.choice("abcde ") for _ in range(random.randint(5, 60))) for _ in range(60)] + ["zz abc qq"]
    docs = perplexity.folds(documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), 2)
    part = {r.doc_id: r.fold for r in docs.collect()}
    assert set(part.values()) == {0, 1}
    model = perplexity.train(docs)
    p = [brute_kneser_ney([t for i, t in enumerate(texts) if part[i] == f]) for f in (0, 1)]
    want = {i: sum(math.log(p[1 - part[i]]((bytes(4) + t.encode())[k : k + 5])) for k in range(len(t))) for i, t in enumerate(texts)}
    for most in (None, 200):
        got = perplexity.score(docs, model, most).collect()
        assert len(got) == len(texts)
        for r in got:
            assert abs(r.logp - want[r.doc_id]) < 1e-3
    assert len(perplexity.shard_ranges(model, 200)) > 3


def test_both_bands_reject(spark):
    """Planted: texts of one phrase over and over (in windows that differ) and of random letters."""
    random.seed(4)
    words = ["".join(random.choice("aeioulnrst") for _ in range(random.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(random.choice(words) for _ in range(80)), "en", "s", 0) for i in range(300)]
    noise = [(1000 + i, " ".join("".join(random.choice("zxqjkvw#0123456789") for _ in range(6)) for _ in range(80)), "en", "s", 0) for i in range(5)]
    dull = [(2000 + i, " ".join(f"{words[0]} {words[1]} {words[2]} {words[0]}{words[1][:k % 2]}" for k in range(30)) + f" {i}", "en", "s", 0) for i in range(5)]
    got = {r.doc_id: r for r in perplexity.perplexity_rules(documents(spark, rows + noise + dull)).collect()}
    assert all(got[i].kept for i in range(300))
    assert not any(got[1000 + i].kept for i in range(5)) and all(got[1000 + i].perplexity > got[0].upper_band for i in range(5))
    assert all(got[2000 + i].perplexity < got[0].lower_band for i in range(5))


# --- 2 ---


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 1, "assistant", "a|<"), (2, None, "odd\nrole %", "<␛|x<|<␛␛|"), (3, 0, None, None), (None, 5, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.read_back(chat.format_chats(df))).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[c].loss_chars == len(loss)
    assert got[1].valid and not got[2].valid and got[2].bad_turn == 0
    text = chat.format_chats(df.filter("conv_id = 1")).first().formatted
    assert text.count("<|im_start|>") == 2 and text.count("<|im_end|>") == 2
    assert chat.digest(chat.read_back(chat.format_chats(df.limit(0)))).collect() == []


# --- 3 ---


def test_suffix_array():
    random.seed(1)
    for _ in range(500):
        s = [random.randint(1, random.choice([1, 2, 3, 26])) for _ in range(random.randint(0, 50))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def slow_removal(texts, length):
    at = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cut = [False] * len(t)
        for i in range(len(t) - length + 1):
            if at[t[i : i + length]] > 1:
                cut[i : i + length] = [True] * length
        out.append((sum(cut), bytes(b for b, c in zip(t, cut) if not c)))
    return out


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_removal_equals_brute_force(spark, group):
    """Passages at every offset, in-document repeats, copies; also with all groups counted by hash."""
    random.seed(7)
    word = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    passages = [word(random.randint(90, 260)) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [word(random.randint(0, 200))]
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            a = random.randint(0, 30)
            parts += [p[a : len(p) - random.randint(0, 30)], word(random.randint(0, 60))]
        texts.append("".join(parts))
    texts += [texts[0], texts[1] + "x", "ab" * 300, "", passages[0] * 3]
    df = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    keep, suffix_dedup.GROUP = suffix_dedup.GROUP, group
    try:
        got = {r.doc_id: r for r in suffix_dedup.removal_digest(df, 100).collect()}
    finally:
        suffix_dedup.GROUP = keep
    for i, (n, rest) in enumerate(slow_removal([t.encode() for t in texts], 100)):
        assert (got[i].n_removed, got[i].kept_sha256) == (n, hashlib.sha256(rest).hexdigest())


def slow_word_removal(texts, length, words):
    """Texts without the bytes of repeated strings and of repeated runs of words."""
    import re

    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    said = [[t[a:b] for a, b in own] for t, own in zip(texts, spans)]
    at = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    runs = Counter(hash(tuple(w[i : i + words])) for w in said for i in range(len(w) - words + 1))
    out = []
    for t, own, w in zip(texts, spans, said):
        cut = [False] * len(t)
        for i in range(len(t) - length + 1):
            if at[hash(t[i : i + length])] > 1:
                cut[i : i + length] = [True] * length
        for i in range(len(w) - words + 1):
            if runs[hash(tuple(w[i : i + words]))] > 1:
                a, b = own[i][0], own[i + words - 1][1]
                cut[a:b] = [True] * (b - a)
        out.append(bytes(b for b, c in zip(t, cut) if not c))
    return out


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """Passages of 51 to 60 words under 400 bytes go, those of 50 words stay; long ones of few words go."""
    import corpus_pipeline

    random.seed(11)
    fresh = lambda n, most=9: [f"{''.join(random.choices('abcdefghü', k=random.randint(1, most)))}" for _ in range(n)]
    short = {n: fresh(n, 5) for n in range(48, 61)}
    wide = fresh(30, 40)
    texts = []
    for n, words in [*short.items(), *((n, w) for n, w in short.items()), ("wide", wide), ("wide", wide)]:
        own = f"#{len(texts)}"  # no word beside the passage is shared
        texts.append(" ".join([*fresh(random.randint(60, 200)), own, *words, own, *fresh(random.randint(60, 200))]))
    texts[20] = texts[20].replace(" ", "\n\t")  # other blanks between the same words
    texts += ["", " ", " ".join(short[51]), "x" * 900]
    docs = documents(spark, [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in corpus_pipeline.suffix_array_dedup(spark, docs, SF).collect()}
    assert all(len(" ".join(w).encode()) < 400 for w in short.values())
    want = slow_word_removal([t.encode() for t in texts], 400, 51)
    for i, rest in enumerate(want):
        assert got[i].text == rest.decode("utf-8", "ignore") and got[i].n_chars == len(got[i].text)
    assert got[28].text == "" and all((" ".join(short[n]) in got[n - 48].text) == (n < 51) for n in short)


# --- 4 ---


def test_pages():
    page = (
        "<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a href=x>m</a></nav><div id=wrap>"
        '<div class="cookie-notice">We use cookies a lot here really</div><div class=content><h1>T &amp; t</h1><p>Hello <a href=q>world</a>,\n'
        '  this is a long text &lt;b&gt; with words.<p>Second para<ul><li>one<li>two</ul></div><div class="sidebar"><p>side stuff long long long long</p></div>'
        '<section id="comments"><p>Nice post!!</p></section></div><form><p>sub</p></form><script>if(a<b)x("</p>")</script><footer>foot</footer>'
    )
    assert html_text.main_text(page) == "T & t\nHello world, this is a long text <b> with words.\nSecond para\none\ntwo"
    assert html_text.main_text(None) == "" and html_text.main_text("<p>a<p>b") == "a\nb"
    assert html_text.main_text("a <3 b & c") == "a <3 b & c"
    assert html_text.main_text("<div>" * 20000 + "deep") == "deep"


def test_article_is_whole(spark):
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.rindex("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert html_text.main_text(r.html) == "\n".join(b for b in blocks if b)


def test_pages_without_article():
    """Text, headings and short paragraphs beside the core stay, in page order; menus go."""
    a, b, c = ("word " * 40).strip(), ("text " * 40).strip(), ("line " * 40).strip()
    core = f"<div><p>{a}</p><p>{b}</p><p>{c}</p></div>"
    whole = f"{a}\n{b}\n{c}"
    menu = "<ul><li><a href=1>One link</a><li><a href=2>Two links</a><li><a href=3>Three links</a></ul>"
    links = "One link\nTwo links\nThree links"
    assert html_text.main_text(f"<body><div>Lead text.{core}</div></body>") == f"Lead text.\n{whole}"
    assert html_text.main_text(f"<body><div><h1>Title</h1>{core}Last words.</div></body>") == f"Title\n{whole}\nLast words."
    assert html_text.main_text(f"<body><div><p>Short.</p>{core}<p>End.</p></div></body>") == f"Short.\n{whole}\nEnd."
    assert html_text.main_text(f"<body>{menu}<div>Lead.{core}</div><nav>{menu}</nav></body>") == f"Lead.\n{whole}"
    assert html_text.main_text(f"<body><div>{menu}</div><div><p>{a}</p><p>{b}</p><p>{c}</p><h2>Sources</h2>{menu}</div></body>") == f"{whole}\nSources\n{links}"
    assert html_text.main_text(f"<body>{menu}<p>{a}</p><p>{b}</p></body>") == f"{a}\n{b}"
    assert html_text.main_text(f"<body><div>{menu}<p>{a}</p><p>{b}</p>{menu}</div></body>") == f"{a}\n{b}\n{links}"
    for kind in ("article", "main"):
        assert html_text.main_text(f"<body>{menu}<{kind}><h1>T</h1><p>{a}</p><p>{b}</p>{menu}</{kind}></body>") == f"T\n{a}\n{b}\n{links}"


# --- 5 ---


def test_fingerprints(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(5000)]
    a, b = (" ".join(random.choices(words, k=900)) for _ in range(2))
    x, y = fingerprints.sketches([a.encode(), (a + " " + b).encode()])
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, a + " " + b)]
    assert abs(fingerprints.resemblance(x, y) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15
    assert fingerprints.containment(x, y) > 0.7
    assert abs(fingerprints.distinct(x) - len(sets[0])) < 0.3 * len(sets[0])
    assert (fingerprints.decode(fingerprints.encode(x)) == x).all()
    parts = fingerprints.sketches([" ".join(a.split()[:500]).encode(), " ".join(a.split()[496:]).encode()])
    assert (fingerprints.merge(*parts) == x).all()
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprints.edited_pairs(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()
    assert len({r.fingerprint for r in got.values()}) <= len({t for _, t in rows})


# --- 6 ---


def test_groups_equal_brute_force(spark, monkeypatch):
    random.seed(9)
    base = [[f"w{random.randint(0, 400)}" for _ in range(random.randint(3, 120))] for _ in range(50)]
    docs = []
    for b in base:
        for _ in range(random.choice([1, 1, 2, 6])):
            d = list(b)
            for _ in range(random.randint(0, max(1, len(d) // 12))):
                d[random.randrange(len(d))] = f"w{random.randint(0, 400)}"
            docs.append(" ".join(d))
    docs += ["", "one", "One", "a b", docs[0].upper()]
    sets = []
    for t in docs:
        w = t.encode().lower().split()
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(lambda x: (x,), w)))
    at = list(range(len(docs)))
    find = lambda i: i if at[i] == i else find(at[i])
    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                at[b] = a
    df = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(docs)])
    for block in (cells.BLOCK, 300):
        monkeypatch.setattr(cells, "BLOCK", block)
        got = {r.doc_id: r for r in near_dedup.near_duplicates(df, width=2).collect()}
        assert [got[i].component_id for i in range(len(docs))] == [find(i) for i in range(len(docs))]
        assert [got[i].n_shingles for i in range(len(docs))] == [len(s) for s in sets]


def test_lists_that_sets_share():
    """Large sets must share MEET lists, small ones what their sizes leave: never more than any partner gives."""
    n = np.arange(4, 400)
    need = near_dedup.meetings_needed(n, 80, 100)
    assert need[0] == 4 and need[-1] == near_dedup.MEET and (np.diff(need) >= 0).all()
    t = np.where(n * 100 < near_dedup.K * 80, -(-n * 80 // 100), near_dedup.least_shared(0.8))
    for size, most in zip(n, need):
        partners = t[(n * 100 >= size * 80) & (size * 100 >= n * 80)]
        assert most <= min(near_dedup.MEET, partners.min())


def test_small_graphs_are_joined_at_once(spark, monkeypatch):
    """Few edges take a few jobs, however long their paths are; more edges give the same."""
    from loomspark.llm import components as module

    edges = materialise(spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 100] + [(7, 7), (None, 3), (1000, 400)], "a long, b long"))
    found = []
    for bound in (module.AT_ONCE, 0):
        monkeypatch.setattr(module, "AT_ONCE", bound)
        spark.sparkContext.setJobGroup(f"components {bound}", "")
        found.append(sorted(map(tuple, module.components(edges).collect())))
        if bound:
            assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {bound}")) <= 12
    assert found[0] == found[1] and (300, 201) in found[0] and (1000, 400) in found[0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 1 for n in (1, 2, 3, 7, 8, 9)} | {20: 20, 21: 20} | {100 + i: 100 for i in range(31)}


# --- 7 ---


def test_hilbert_is_a_curve():
    n = 8
    grid = np.stack(np.meshgrid(range(n), range(n), indexing="ij"), -1).reshape(-1, 2)
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(n * n))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_holds_every_token(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, tokenizer()).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for d, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids[d]) == own[0].doc_tokens
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        total = sum(r.length for r in s)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]] and total <= 1024 and total & (total - 1) == 0
    assert set(pieces) == set(ids)


def test_added_tokens_are_found_inside_text(spark):
    from tokenizers import Tokenizer

    t, end = Tokenizer.from_file(tokenizer()), "<|endoftext|>"
    random.seed(12)
    texts = [f"a {end} b", end, f"{end}{end}", f" {end} ", f"x \n {end}\n\n y", f"<|{end}|>", "<|endoftext|", f"ü{end}é", f"a  {end}  'll"]
    texts += ["".join(random.choices([end, " ", "  ", "\n", "ab", "don't", "é", "12", "<|", "|>"], k=random.randint(1, 12))) for _ in range(200)]
    texts.append(f"word {end} " * 3000)
    ids = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert ids[0] == [64, 220, 50256, 275, 0]
    seen = Counter()
    for r in packing.pack_documents(documents(spark, [(i, x, None, None, 0) for i, x in enumerate(texts)]), tokenizer()).collect():
        seen[r.doc_id] += r.length
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert seen == {i: len(x) for i, x in enumerate(ids)}


def test_pieces_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {tuple(r) for r in packing.pack_documents(docs, tokenizer(), size=1 << 18).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        two = {tuple(r) for r in packing.pack_documents(docs.repartition(9), tokenizer(), size=1 << 18).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two and len({r[5] >> 32 for r in one}) > 4


# --- 8, 10 ---


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs, langid.train(langid.learning_sample(docs))).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r.lang_pred for r in langid.identify(documents(spark, [(1, None, None, None, 0), (2, "12 !?", None, None, 0)]), langid.train([("the cat", "en"), ("der hund", "de")])).collect()}
    assert odd == {1: "und", 2: "und"}


def test_quality_accuracy(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.train(quality.learning_sample(docs, labels))
    held = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(labels.withColumnRenamed("doc_id", "id"), F.col("id") == F.col("doc_id"))
    rows = quality.score_documents(held.select("doc_id", "text", "quality"), model).collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


# --- 9 ---


def slow_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)


def test_mixing_meets_targets(spark):
    random.seed(2)
    rows = [(i, "w " * random.randint(0, 50), None, random.choice(["a", "b", "c", "d", None]) if i > 100 else "b", 0) for i in range(600)]
    rows += [(1000, "x y", None, "zz", 0), (1001, None, None, "e", 0)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    of = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, taken = slow_targets(dict(sizes)), Counter()
    for r in got:
        taken[of[r.doc_id]] += r.taken
        assert abs(r.target - want[of[r.doc_id]]) < 1e-6 and r.source_size == sizes[of[r.doc_id]] and 0 <= r.taken <= 3 * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2  # whole copies only
    assert all(r.size == 0 or r.taken % r.size == 0 for r in got)
    # Of one source, longer documents are sampled more often; none more than once beyond its certain copies.
    rate = {r.doc_id: r.target / max(r.source_size, 1) for r in got}
    assert all(r.taken // r.size - int(rate[r.doc_id] + 1e-9) in (0, 1) for r in got if r.size)
    again = mixing.mix_sources(documents(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_sources_without_a_sample_have_no_edge(spark):
    """One source alone is taken whole and meets in no task; of two, only the one with a rest is cut."""
    bins = [("a", 95, 500, 9, 500), ("b", 3, 10, 1, 15), ("b", 4, 10, 1, 15), ("b", 7, 10, mixing.FIT, 15), ("b", 9, 10, 1, 15)]
    edges = mixing.sample_edges(spark.createDataFrame(bins, "skey string, bin int, words long, docs long, rest long")).collect()
    assert [tuple(r) for r in edges] == [("b", 4, 10, 7)]
    rows = [(i, "w " * (i % 7), None, "only", 0) for i in range(50)]
    assert all(r.taken == r.size for r in mixing.mix_sources(documents(spark, rows)).collect())


# --- pipeline ---


def slow_groups(texts, width):
    """The first text of the group of each, by comparing all sets that share a shingle of their rarest fifth."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    df = Counter(x for s in sets for x in s)
    at, lists = list(range(len(texts))), defaultdict(list)

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (df[x], x))[: len(s) - math.ceil(0.8 * len(s)) + 1]:
            for j in lists[x]:
                n = len(s & sets[j])
                if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                    p, q = sorted((find(i), find(j)))
                    at[q] = p
            lists[x].append(i)
    return [find(i) for i in range(len(texts))]


def test_pipeline_stages(spark):
    """Every stage on what the one before kept, against brute force."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from loomspark.llm.common import materialise, table

    docs = table(spark, SF, "documents")
    rows, seen = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.orderBy("doc_id").collect()
        docs, columns = materialise(stage(spark, docs, SF)), docs.columns
        if name != "curve_packing":
            assert docs.columns == columns
        after = docs.orderBy("doc_id").collect() if name != "curve_packing" else docs.collect()
        rows[name], seen[name] = before, after
    # 1. Those that score enough, all else as it was.
    model = quality.train(quality.learning_sample(table(spark, SF, "documents"), table(spark, SF, "labels")))
    good = [r for r in rows["quality_classifier"] if slow_score(model, r.text) >= corpus_pipeline.LEAST_QUALITY]
    assert seen["quality_classifier"] == good and 0 < len(good) < len(rows["quality_classifier"])
    # 2. The first of each group.
    before = rows["minhash_near_dedup"]
    first = slow_groups([r.text for r in before], 5)
    assert seen["minhash_near_dedup"] == [r for i, r in enumerate(before) if first[i] == i]
    # 3. No byte of a repeated passage.
    before = rows["suffix_array_dedup"]
    left = [t.decode() for t in slow_word_removal([(r.text or "").encode() for r in before], 400, 51)]
    assert [r.text or "" for r in seen["suffix_array_dedup"]] == left and any(len(t) < len(r.text or "") for t, r in zip(left, before))
    # 4. Whole copies, the rows as they were.
    before = {r.doc_id: r for r in rows["source_mixing"]}
    copies, words = Counter(r.doc_id for r in seen["source_mixing"]), Counter()
    assert set(seen["source_mixing"]) <= set(before.values()) and max(copies.values()) <= 3
    size = {i: len((r.text or "").split()) for i, r in before.items()}
    sources = Counter()
    for i, r in before.items():
        sources[r.source] += size[i]
        words[r.source] += copies[i] * size[i]
    for source, target in slow_targets(dict(sources)).items():
        assert abs(words[source] - target) <= max(5, 0.01 * target)
    # 5. All tokens, once for each copy.
    tok = Tokenizer.from_file(tokenizer())
    ids = {i: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for i, r in before.items()}
    assert sum(r.length for r in seen["curve_packing"]) == sum(len(ids[i]) * n for i, n in copies.items())
    for r in seen["curve_packing"]:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])


def slow_score(model, text):
    """Margin over the set of a text's indicators, one at a time."""
    raw, offs = list_bytes([(text or "").encode()])
    found = set(quality.indicators(raw, offs)[1].tolist())
    length = math.sqrt(sum(model.scale[f] ** 2 for f in found))
    margin = sum(model.scale[f] * model.weight[f] for f in found) / max(length, 1e-12) + model.bias
    return 1 / (1 + math.exp(-(model.slope * margin + model.shift)))


def slow_language(model, text):
    """Mean of the rows of all n-grams of a text, looked up one at a time."""
    raw, offs = list_bytes([text.encode()])
    grams = [f for s in langid.SIZES for f in langid.features(raw, offs, s)[0]]
    z = [(sum(model.table[k][f] for f in grams) / max(len(grams), 1) + model.bias[k]) / model.temperature for k in range(len(model.langs))]
    e = [math.exp(x - max(z)) for x in z]
    return model.langs[z.index(max(z))], max(e) / sum(e)


def test_scores_equal_brute_force(spark):
    """The queries op8 and op10: every document's columns against scores made one at a time."""
    from loomspark.llm.common import table
    from loomspark.llm.queries import QUERIES

    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    model = langid.train(langid.learning_sample(docs))
    got = QUERIES["op8_langid"](spark, SF)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    for r in got.collect():
        assert r.held_out == held[r.doc_id]
        if any(c.isalpha() for c in texts[r.doc_id] or ""):
            lang, p = slow_language(model, texts[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - p) < 1e-6
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    model = quality.train(quality.learning_sample(docs, table(spark, SF, "labels")))
    got = QUERIES["op10_quality"](spark, SF)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    for r in got.collect():
        assert r.held_out == held[r.doc_id] and abs(r.score - slow_score(model, texts[r.doc_id])) < 1e-6 and r.predicted == (r.score >= 0.7)


def test_parts_merge_into_the_whole(spark):
    """Fingerprints of parts that overlap by four words, over many rows and tasks, merge into those of the texts."""
    random.seed(8)
    texts = {i: [f"w{random.randint(0, 3000)}" for _ in range(random.choice([3, 40, 900]))] for i in range(6)}
    parts = [(i, " ".join(w[a : a + 24]), None, None, 0) for i, w in texts.items() for a in range(0, max(1, len(w) - 4), 20)]
    whole = documents(spark, [(i, " ".join(w), None, None, 0) for i, w in texts.items()])
    merged = fingerprints.merge_fingerprints(fingerprints.fingerprint_documents(documents(spark, parts).repartition(5)), "doc_id")
    want = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(whole).collect()}
    assert {r.doc_id: r.fingerprint for r in merged.collect()} == want


def test_estimates_are_near_exact_likeness(spark):
    """near_edited and near_next of op5 against exact Jaccard of five-word shingles."""
    from loomspark.llm.common import table

    rows = sorted((r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect())[:300]
    got = {r.doc_id: r for r in fingerprints.edited_pairs(documents(spark, [(i, t, None, None, 0) for i, t in rows])).collect()}

    def likeness(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.encode().split(), b.encode().split()))
        return len(x & y) / len(x | y) if x | y else 1.0

    off = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        off += [abs(got[i].near_edited - likeness(t, edited)), abs(got[i].near_next - likeness(t, after))]
    assert max(off) < 0.2 and sum(off) / len(off) < 0.02


def test_quality_training_holds_little():
    """Fitting takes no memory for the scaled values of all features."""
    import tracemalloc

    rows = [np.random.default_rng(i).permutation(1 << 12)[:2000].astype(np.int32) for i in range(1000)]
    tracemalloc.start()
    quality.dual_descent(rows, np.random.default_rng(5).random(1 << 12), np.where(np.arange(1000) % 2, 1, -1), 1.0, 1, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20
