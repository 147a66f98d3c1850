"""Decontamination, packing, token counts, quality, language, chat, pages and search against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from seqlake.llm import chat, decontaminate, html_extract, langid, packing, quality, token_counts, topk
from seqlake.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "Don't<|startoftext|>'s 12<|endoftext|>é", "<|ENDOFTEXT|> <|endoftext| <|end oftext|>", "x <|endoftext|> y <|startoftext|>\n\n z", "汉<|endoftext|>字"]
ODD = [None, "", " \n", "<|endoftext|> don't İSTANBUL ΣΑΣ x\x0by é 汉字 3456 '''s 🙂", "a" * 3000, "Straße ﬁn ½ ²", "́x", "word " * 9000]


def rows_of(texts):
    return [(i, t, "en", i) for i, t in enumerate(texts)]


# ------------------------------------------------------------ decontamination


def brute_hits(text, items, window):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda t: re.findall(word, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = cut(text), set(), set()
    for i, t in items:
        x = cut(t)
        for g in [x] if 0 < len(x) < window else [x[k : k + window] for k in range(len(x) - window + 1)]:
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("seed,limit", [(1, None), (2, None), (3, 60)])
def test_contamination_matches_brute_force(spark, monkeypatch, seed, limit):
    if limit:
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)
    r = random.Random(seed)
    v = ["a", "B", "c1", "dé", "e"]
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 5, 6, 9]))) for i in range(9)] + [(10, None), (11, ""), (2, say(7)), (12, "...")]
    docs = [say(r.randint(0, 40)) for _ in range(40)] + [None, "", "!!", "a" * 50, "B, c1-dé"]
    df = spark.createDataFrame(rows_of(docs), "doc_id long, text string, lang string, items long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: tuple(x)[1:] for x in decontaminate.contamination_report(df, bench, 4).collect()}
    assert got == {i: brute_hits(t, items, 4) for i, t in enumerate(docs)}


def test_decontaminate_removes_spans_and_mostly_hit_documents(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    body = "clean words before these and still some more of them here ONE two, three four five six seven eight nine ten. And after it plenty of clean words too"
    df = spark.createDataFrame([(1, body, 3), (2, "one two three four five six seven eight nine ten", 1), (3, None, 0), (4, "fine", 4)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.decontaminate(df, bench).collect()}
    left = "clean words before these and still some more of them here . And after it plenty of clean words too"
    assert got == {1: (left, len(left)), 3: (None, 0), 4: ("fine", 4)}
    assert decontaminate.contamination_report(df.limit(0), bench).count() == 0
    assert decontaminate.contamination_report(df, bench.limit(0)).where("contaminated").count() == 0


def brute_left(text, items, window, coverage=0.5):
    """The text without its hit words and what stands between neighbours of them; None if it goes."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    at, hit = list(re.finditer(word, low(text))), set()
    w = [m[0] for m in at]
    for _, t in items:
        x = re.findall(word, low(t))
        for g in [x] if 0 < len(x) < window else [x[k : k + window] for k in range(len(x) - window + 1)]:
            hit |= {q for p in range(len(w) - len(g) + 1) if w[p : p + len(g)] == g for q in range(p, p + len(g))}
    if len(hit) > coverage * len(w):
        return None
    out, done = "", 0
    for p in sorted(hit):
        if p - 1 not in hit:
            out += text[done : at[p].start()]
        done = at[p].end()
    return out + (text or "")[done:]


@pytest.mark.parametrize("limit", [None, 60])
def test_decontaminate_is_the_same_with_any_number_of_automata(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)
    r = random.Random(5)
    v = [f"{c}{n}" for c in "abcdé" for n in range(12)]
    passage = [r.choice(v) for _ in range(600)]
    cut = lambda n: " ".join(passage[(k := r.randrange(590)) : k + n])
    items = [(i, cut(r.choice([4, 6, 9, 14]))) for i in range(40)]
    docs = [" ".join([cut(r.randint(1, 40)), " ".join(r.choice(v) for _ in range(r.randint(0, 30))), cut(r.randint(1, 20))]) for _ in range(60)] + ["", "A1, b2"]
    rows = [(i, t, len(t)) for i, t in enumerate(docs)] + [(3, docs[3], len(docs[3])), (3, docs[4], len(docs[4])), (None, docs[5], len(docs[5]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in decontaminate.decontaminate(df, bench, 4).collect()]
    want = [(i, left, len(left)) for i, t, _ in rows if (left := brute_left(t, items, 4)) is not None]
    key = lambda x: (x[0] is None, x)
    assert 0 < sum(len(x[1]) for x in want) < sum(x[2] for x in rows) and sorted(got, key=key) == sorted(want, key=key)


# -------------------------------------------------------------------- packing


def test_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = ODD + SPECIAL
    df = spark.createDataFrame(rows_of(texts), "doc_id long, text string, piece string, length long")
    got = packing.pack_documents(df, PATH, 512, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for p in parts for x in p["ids"]] == want
        assert [p["start"] for p in parts] == list(range(0, len(want), 512))
        assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and p["length"] == len(p["ids"]) for p in parts)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_bounds_and_rounds_of_packing(spark, monkeypatch):
    r = random.Random(4)
    for _ in range(60):
        x = np.array([r.randint(1, 40) for _ in range(r.randint(1, 30))])
        place, offset, made = packing.best_fit_decreasing(x, 40)
        assert packing.lower_bound(x, 40) <= made and np.bincount(place, x).max() <= 40
    assert packing.lower_bound(np.array([21] * 5), 40) == 5
    assert packing.lower_bound(np.array([14] * 4), 40) == 2
    monkeypatch.setattr(packing, "TOGETHER", 40)
    lengths = [r.randint(1, 100) for _ in range(400)]
    df = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df, 100).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(400))
    load = {}
    for x in got:
        load[x["sequence_id"]] = load.get(x["sequence_id"], 0) + x["length"]
    assert max(load.values()) <= 100 and len(load) <= 1.08 * packing.lower_bound(np.array(lengths), 100)


# --------------------------------------------------------------- token counts


def greedy(tokens, word):
    n = at = 0
    while at < len(word):
        size = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in tokens), default=0)
        if not size:
            return None
        n, at = n + 1, at + size
    return n


def test_longest_match_counts():
    r = random.Random(6)
    for _ in range(40):
        tokens = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 14))}
        m = token_counts.LongestMatch(sorted(tokens))
        for _ in range(60):
            w = bytes(r.choice(b"abc") for _ in range(r.randint(0, 14)))
            assert m.count(w) == greedy(tokens, w)


def test_token_counts_of_odd_texts(spark):
    c = token_counts.TokenCounter(PATH)
    import json
    import unicodedata

    vocab = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}

    def plainly(text):
        low = unicodedata.normalize("NFC", text or "")
        words = [w for chunk in re.split(r"[ \t\n\r\x0b\x0c]+", low) for w in c.any_split.findall(unicodedata.normalize("NFC", chunk).lower())]
        total = 0
        for w in words:
            s, n = [shown[b] for b in w.encode()] + ["</w>"], 0
            while s:
                if s == ["</w>"]:
                    break
                k = max(k for k in range(1, len(s) + 1) if "".join(s[:k]) in vocab)
                n, s = n + 1, s[k:]
            total += n
        return len(words), total

    texts = [t for t in ODD if t is None or len(t) < 5000]
    df = spark.createDataFrame(rows_of(texts), "doc_id long, text string, n_words string, x long")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(df, PATH).collect()}
    assert got == {i: plainly(t) for i, t in enumerate(texts)}
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


# ------------------------------------------------------- quality and language


def good(r):
    return " ".join(r.choice(["the", "of", "river", "stone", "walks", "quiet"]) for _ in range(r.randint(20, 60))).capitalize() + "."


def test_quality_learns_and_takes_any_row(spark):
    r = random.Random(2)
    docs = [(i, good(r) if i % 5 else good(r).upper().replace(" ", "!! "), "en") for i in range(400)]
    df = spark.createDataFrame([*docs, (400, None, None), (401, "", None), (None, "x", None), (402, "| " * 20000, "en"), (402, "| " * 20000, "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    m = quality.fit(df, labels)
    got = quality.score_quality(df, m).collect()
    assert len(got) == 405 and all(0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 400 and x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in held)
    assert np.mean([x["predicted"] == int(x["doc_id"] % 5 > 0) for x in held]) > 0.95
    assert quality.keep_good(df, m).columns == df.columns
    assert quality.score_quality(df.limit(0), quality.fit(df.limit(0), labels.limit(0))).count() == 0


def test_nnpu_separates_with_positives_and_mixture_alone():
    rng = np.random.default_rng(0)
    p = rng.normal(1, 1, (800, 3))
    u = np.concatenate([rng.normal(1, 1, (700, 3)), rng.normal(-2, 1, (300, 3))])
    m = quality.fit_nnpu(p, u, 0.7)
    assert (m.raw(rng.normal(1, 1, (500, 3))) > 0).mean() > 0.9 and (m.raw(rng.normal(-2, 1, (500, 3))) > 0).mean() < 0.1


def test_nnpu_risk_and_its_slopes():
    """The two parts against sums over single rows, the slopes against differences."""
    rng = np.random.default_rng(1)
    p, u, w, prior = rng.normal(1, 1, (7, 3)), rng.normal(0, 1, (11, 3)), rng.normal(0, 1, 3), 0.3
    cost = lambda z: float(np.log(1 + np.exp(-z)))
    parts = lambda w: (prior * sum(cost(x @ w) for x in p) / 7, sum(cost(-x @ w) for x in u) / 11 - prior * sum(cost(-x @ w) for x in p) / 7)
    *risk, a, b = quality.nnpu_risk(w, p, u, prior)
    assert np.allclose(risk, parts(w))
    for k in range(3):
        d = np.zeros(3)
        d[k] = 1e-6
        assert np.allclose([a[k], b[k]], (np.array(parts(w + d)) - np.array(parts(w - d))) / 2e-6, atol=1e-6)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_class_prior_from_positives_and_mixture(share):
    rng = np.random.default_rng(7)
    n = int(4000 * share)
    p = rng.normal(1.2, 1, (1500, 4))
    u = rng.permutation(np.concatenate([rng.normal(1.2, 1, (n, 4)), rng.normal(-1.2, 1, (4000 - n, 4))]))
    assert abs(quality.class_prior(p, u) - share) < 0.06


def test_quality_fit_is_bounded_and_takes_repeated_ids(spark):
    r = random.Random(3)
    docs = [(i, good(r) if i % 4 else good(r).upper().replace(" ", "!! ")) for i in range(300)]
    df = spark.createDataFrame(docs + docs[:50], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] * 2 + [(8, 1), (9, 5)], "doc_id long, quality int")
    m = quality.fit(df, labels, labelled=150, unlabelled=150)
    held = [x for x in quality.score_quality(df, m).collect() if x["held_out"]]
    assert np.mean([x["predicted"] == int(x["doc_id"] % 4 > 0) for x in held]) > 0.9
    none = quality.fit(df, labels.where("quality = 0"))
    assert {x["score"] for x in quality.score_quality(df, none).collect()} == {0.5}


def test_language_identification(spark):
    r = random.Random(8)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["schn", "üt", "ber"], "zz": ["ção", "des", "aux"]}
    say = lambda g: " ".join("".join(r.choice(parts[g]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40)))
    docs = [(i, say(g), g) for i in range(450) for g in [["xx", "yy", "zz"][i % 3]]]
    df = spark.createDataFrame([*docs, (900, None, "xx"), (901, "", None), (902, "123 --", "xx"), (903, "¿…—", None), (904, "汉字", None), (None, say("yy"), "yy")], "doc_id long, text string, lang string")
    m = langid.fit(df)
    got = {x["doc_id"]: x for x in langid.identify(df, m).collect()}
    held = [i for i in range(450) if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == docs[i][2] for i in held]) > 0.97
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902, 903)] == [("und", 0.0)] * 4
    assert got[904]["lang_pred"] in parts and all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).count() == 0


# ----------------------------------------------------------------------- chat


def test_chat_reads_back_what_it_formatted(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>\n", "<|assistant|>\nhi", "<\\|x", "<\\\\|", "a<|", "", None, "|>\n", "🙂é\n\n", "x" * 5000, "$1 \\1"]
    rows = [(1, i, ["user", "assistant"][i % 2], t, "z") for i, t in enumerate(odd)] + [(2, 0, "system", "only", "z"), (3, 0, None, "<|end|>", "z"), (3, 0, "assistant", "tie", "z"), (3, 0, "assistant", "tie", "z"), (None, 1, "assistant", "n", "z"), (4, None, "assistant", "first", "z"), (4, 0, "user", "last", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target string")
    ex = chat.examples(df)
    got = {r["conv_id"]: r for r in chat.digest(ex).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        flat = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(flat.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    first = {r["example"]: r for r in ex.where("conv_id = 1").collect()}
    assert len(first) == 6 and all(r["prompt"].endswith("<|assistant|>\n") for r in first.values())
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


# ---------------------------------------------------------------------- pages

LONG = "Long article text with many words that goes on, and on. " * 6
PAGES = [
    (f"<html><body><div id=header><a href=/>Home</a></div><div class='main-content'><h1>Title</h1><div><p>{LONG}</p><p>Second {LONG}</p><ul><li>one item<li>two item</ul><table><tr><td>c1<td>c2</table></div></div><div class='sidebar'><p>Side {LONG}</p></div><div id='comments'><p>{LONG}</p></div><form><p>x</p></form></body></html>", f"Title {LONG.strip()} Second {LONG.strip()} one item two item c1 c2"),
    ("<body><p>Short.</p></body>", "Short."),
    ("plain text only", "plain text only"),
    ("", ""),
    (None, ""),
    ("<body><nav>x</nav></body>", ""),
    (f"<body><main><section><h2>A</h2><p>short one</p></section><section><h2>B</h2><p>{LONG}</p></section></main><footer>f</footer></body>", f"A short one B {LONG.strip()}"),
    ("<article><p>one&nbsp;&lt;b&gt; <b>bold</b>text</p><p>x<!-- c -->y</p></article>", "one <b> boldtext xy"),
    (f"<body class='has-sidebar'><article><header><h1>T</h1></header><p><b>{LONG}<br><p>next</article><aside>{LONG}</aside><div class='cookie-notice'>ok?</div></body>", f"T {LONG.strip()} next"),
    ("<p>" * 3000 + "deep", "deep"),
    (f"<body><article><script>var t='</p>';</script><style>p{{}}</style><p>{LONG}</p><noscript>no</noscript></article><div class=ad>{LONG}</div></body>", LONG.strip()),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, 1) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text long")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_extract.extract_main_text(df).collect()}
    assert got == {i: (f"u{i}", w, len(w)) for i, (_, w) in enumerate(PAGES)}
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_main_text_beside_larger_noise():
    """Comments, sidebars and footers that outweigh the article."""
    text = "Article words. " * 14
    other = "Other people say things. " * 13
    for noise in (f"<div id='comments'><p>{other}</p><p>{other}</p></div>", f"<div class=sidebar><ul><li>{other}<li>{other}</ul></div>", f"<footer><div><p>{other}</p><p>{other}</p></div></footer>"):
        assert html_extract.main_text(f"<body><article><p>{text}</p></article>{noise}</body>") == text.strip()


def test_main_text_among_blocks_without_telling_names():
    """Menus, link lists and promotion under neutral class names go, however large; dense blocks beside the path stay."""
    text = "Article words that make up a long sentence of the story. " * 5
    links = "".join(f"<li><a href=/{i}>Some other page {i}</a></li>" for i in range(60))
    offers = "".join(f"<div><span>Buy</span> <b>{i}</b> <i>now</i></div>" for i in range(60))
    article = f"<p>{text}</p><p>Second. {text}</p>"
    want = f"{text.strip()} Second. {text.strip()}"
    body = lambda x: html_extract.main_text(f"<html><body>{x}</body></html>")
    assert body(f"<div class=wrap><div class=c1><ul>{links}</ul></div><div class=c2>{article}</div></div>") == want
    assert body(f"<div class=wrap><div class=c1>{offers}</div><div class=c2>{article}</div></div>") == want
    assert body(f"<div class=c1><ul>{links}</ul></div><div class=c2><h1>Title</h1><div class=c3>{article}</div></div>") == f"Title {want}"
    assert body(f"<div class=w><h3>More</h3><ul>{links}</ul><div class=c2>{article}</div></div>") == want
    assert body(f"<main><div class=c1><ul>{links}</ul></div><div class=c2>{article}</div><div class=c3><p>The end.</p></div></main>") == f"{want} The end."
    assert body(f"<div class=w><div class=c2>{article}{article}</div><div class=c1>{offers}</div><div class=c3><p>Third. {text}</p></div></div>") == f"{want} {want} Third. {text.strip()}"
    assert body(f"<div class=c1><ul>{links}</ul></div>{article}") == want


def test_main_text_is_decided_by_density_not_by_names():
    """Misleading names on article text, and boilerplate without a listed name."""
    text = "Article words that make up a long sentence of the story. " * 5
    links = "".join(f"<li><a href=/{i}>Some other headline of the day {i}</a></li>" for i in range(30))
    body = lambda x: html_extract.main_text(f"<html><body>{x}</body></html>")
    for name in ("top-stories", "bottombox", "c9"):
        assert body(f"<div class={name}><ul>{links}</ul></div><div class=x><p>{text}</p><p>{text}</p></div>") == f"{text.strip()} {text.strip()}"
    assert body(f"<article class='related-reading story'><p>{text}</p></article>") == text.strip()
    assert body(f"<div class=comments-on-law><p>{text}</p><p>{text}</p></div>") == f"{text.strip()} {text.strip()}"
    assert body(f"<h1>Law</h1><div class=comments-on-law><p>{text}</p><p>{text}</p></div>").endswith(f"{text.strip()} {text.strip()}")
    assert body(f"<article><p>{text}</p><p class='legal-news'>{text}</p></article>") == f"{text.strip()} {text.strip()}"
    assert body(f"<article><p>{text}</p><div class=ad>Buy now, only today</div><p>{text}</p></article>") == f"{text.strip()} {text.strip()}"


def plain_densities(node, page_ratio):
    """Every node's density and sum over its children by the published formula, from its whole subtree each time."""
    import math

    def counts(n):
        c = n.weight * sum(len("".join(p.split())) for p in n.parts if isinstance(p, str))
        t = lc = lt = 0
        for p in n.parts:
            if not isinstance(p, str) and not p.noise:
                pc, pt, plc, plt = counts(p)
                c, t, lc, lt = c + pc, t + pt + 1, lc + plc, lt + plt
        return (c, t, c, t + 1) if n.tag == "a" else (c, t, lc, lt)

    def density(n):
        c, t, lc, lt = counts(n)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + page_ratio * c + math.e)
        if base <= 1:  # no links anywhere
            return c / max(t, 1)
        return (c / max(t, 1)) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / math.log(base)

    return density(node), sum(density(p) for p in node.parts if not isinstance(p, str) and not p.noise)


def test_densities_and_sums_match_the_formula_on_random_trees():
    r = random.Random(12)

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return "word " * r.randint(0, 12)
        tag = r.choice(["div", "section", "p", "a", "span", "ul", "nav", "div class=ad", "div class=share"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.randint(0, 4))) + f"</{tag.split()[0]}>"

    for _ in range(60):
        root = html_extract.parse("<html><body>" + "".join(tree(4) for _ in range(3)) + "</body></html>")
        nodes = html_extract._nodes(root)
        body = next(n for n in nodes if n.tag == "body")
        ratio = html_extract._measure(nodes, body)
        assert ratio == body.link_chars / max(body.chars, 1)
        for n in nodes:
            assert np.allclose((n.density, n.total), plain_densities(n, ratio))
        best = max(nodes, key=lambda n: n.total)
        assert np.isclose(best.total, max(plain_densities(n, ratio)[1] for n in nodes))


# --------------------------------------------------------------------- search


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "COMPONENTS", 70 * 9)
    monkeypatch.setattr(topk, "QUERIES_LEAST", 3)
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.2, (300, 9))
    v[40:60] = v[40]
    rows = [(i, [float(x) for x in np.float32(x)], 0, 0) for i, x in enumerate(v)]
    rows += [(300, None, 0, 0), (350, [0.1, None] + [0.0] * 7, 0, 0), (400, [float("nan")] + [0.0] * 8, 0, 0), (450, [], 0, 0), (500, [0.5, 0.5], 0, 0), (rows[5][0], rows[5][1], 0, 0), (None, rows[5][1], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank int")
    got = {}
    for r in topk.top_k(df, 5, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    w = np.floor(256 * v.astype(np.float32).astype(np.float64)).astype(int)
    want = {}
    for q in range(0, 300, 10):
        s = w @ w[q]
        best = sorted((-s[j], j) for j in [*range(300), 5] if j != q)[:5]  # row 5 stands there twice
        want[q] = [(k + 1, j, -x) for k, (x, j) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_takes_all_rows_of_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "COMPONENTS", 50 * 4)
    monkeypatch.setattr(topk, "QUERIES_LEAST", 3)
    rng = np.random.default_rng(8)
    v = rng.integers(-9, 10, (120, 4))
    ids = [int(i) for i in rng.integers(0, 40, 100)] + [7] * 20
    ids, v = [*ids, *ids[:30], *ids[:4]], np.concatenate([v, v[:30], v[:4]])  # repeated rows count each time
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    rows = [(i, tuple(x.tolist())) for i, x in zip(ids, v)]
    want = {}
    for q, x in rows:
        if q % 10 == 0:
            want.setdefault(q, []).extend((-int(np.dot(x, y)), j) for j, y in rows if j != q)
    want = [(q, k + 1, j, -s) for q in want for k, (s, j) in enumerate(sorted(want[q])[:5])]
    assert sorted(tuple(r) for r in topk.top_k(df, 5, 10, 1).collect()) == sorted(want)


def test_index_reads_a_part_and_rescores_few():
    """On vectors with structure the proof stands before all is read, and few rows are scored exactly."""
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 0.2, (40, 32))
    v = np.floor(256 * (centre[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 32)))).astype(np.int64)
    index = topk.ImpactIndex(np.arange(4000), v)
    for q in range(0, 4000, 100):
        ids, score = index.search(v[q], 5, q)
        want = sorted((-int(s), j) for j, s in enumerate(v @ v[q]) if j != q)[:5]
        assert list(zip((-score).tolist(), ids.tolist())) == want
    assert index.reads < 0.9 * 40 * v.size and index.rescored < 0.03 * 40 * 4000


def test_scores_beyond_doubles_are_exact(spark):
    big = [(0, [3e14, 1.0]), (1, [3e14, 2.0]), (2, [3e14, 3.0]), (50, [-3e14, 5.0])]
    index = topk.ImpactIndex(np.array([i for i, _ in big]), np.array([[int(y) for y in x] for _, x in big], np.int64))
    ids, score = index.search(np.array([3 * 10**14, 1]), 2, 0)
    assert ids.tolist() == [2, 1] and [int(x) for x in score] == [9 * 10**28 + 3, 9 * 10**28 + 2]
    df = spark.createDataFrame([(i, [y / 256 for y in x]) for i, x in [(0, [2e7, 1.0]), (1, [2e7, 2.0]), (2, [2e7, 3.0])]], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(df, 2).orderBy("rank").collect()] == [(2, 4 * 10**14 + 3), (1, 4 * 10**14 + 2)]
