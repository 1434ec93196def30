from pyspark.sql import functions as F

from sigtrail.llm import decontaminate, html_extract, language_id, license_scan, secret_scan

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify_language(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, frame, empty):
    docs = frame([(1, "plain english words"), (2, None), (3, ""), (4, "123 ... !!"), (None, "more words"), (1, "plain english words")])
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify_language(docs).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= got
    assert language_id.identify_language(empty).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_language(unlabelled).collect()} == {"und"}


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 40):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n and set(code.ravel()) == {1.0, -1.0}
        assert all(0 < (code[:, b] > 0).sum() < n for b in range(code.shape[1]))


def test_every_label_is_learned(spark):
    rows = [(i, f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}q{chr(97 + k // 676)} " * 9, f"l{k:03}") for k in range(600) for i in (4 * k, 4 * k + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.languages) == 600 and model.code.shape[0] == 600
    assert sum(model.predict(t)[0] == x for _, t, x in rows) > 0.95 * len(rows)


def test_training_against_plain_counts(spark):
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and text is not null").select("lang", "text")
    model, sums = language_id.train(docs), {}
    for r in docs.collect():
        if (found := language_id.features(r.text)) is not None:
            sums[r.lang] = sums.get(r.lang, 0) + np.bincount(found, minlength=language_id.BUCKETS)
    share = np.array([(sums[x] + 0.1) / (sums[x] + 0.1).sum() for x in model.languages])
    for b in range(model.code.shape[1]):
        w = np.log(share[model.code[:, b] > 0].mean(0)) - np.log(share[model.code[:, b] < 0].mean(0))
        assert np.allclose(model.weights[:, b], w, atol=1e-5)
        assert np.isclose(model.middle[b], ((share[model.code[:, b] > 0] @ w).min() + (share[model.code[:, b] < 0] @ w).max()) / 2, atol=1e-4)


def test_language_clashing_and_long(spark):
    rows = [(1, "plain english words of a text " * 40_000, "en", "x", 1.0, 7), (1, "plain english words", "en", "y", 2.0, 8), (2, "des mots de la langue", "fr", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, held_out int")
    got = language_id.identify_language(docs, carry=["text", "lang"]).collect()
    assert sorted((r.doc_id, len(r.text), r.lang) for r in got) == sorted((r[0], len(r[1]), r[2]) for r in rows)
    assert {r.lang_pred for r in got} == {"en", "fr"}


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def extract(spark, rows):
    return {r.page_id: r for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_boilerplate_goes_by_element_and_name(spark):
    body = "<nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>Head &amp; line</h1><p><b>One<br><p>two &eacute;&#233;\n three</p><aside>side</aside></article><section id='comments'>I say</section><footer>foot</footer>"
    got = extract(spark, [(1, "http://a/x", page(body)), (2, None, None), (3, "http://a/y", ""), (4, "http://a/z", "plain &lt; text")])
    assert got[1].text == "Head & line One two éé three" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == "" and got[4].text == "plain < text"


def test_html_templates_are_counted_per_host(spark):
    made = lambda k: page(f"<div><p>Box of this site</p></div><p>Own text {k}</p><div><p>Once {k}</p></div>")
    rows = [(k, "https://one.example/p", made(k)) for k in range(6)] + [(100 + k, f"https://two{k}.example/p", made(k)) for k in range(6)]
    got = extract(spark, rows)
    assert got[3].text == "Own text 3 Once 3" and got[3].n_template > 0
    assert got[103].text == "Box of this site Own text 3 Once 3"


def test_html_copied_pages_without_an_article_stay(spark):
    copied = page("<div><h2>Head</h2><p>First part of it.</p></div><div><ul><li>One</li><li>Two</li></ul><p>Second part.</p></div>")
    few = lambda k: page(f"<h2>A heading that few share</h2><p>Own and longer text of page {k} here</p>")
    most = lambda k: page(f"<div><p>A long text that is nearly all of these pages</p></div><p>{k}</p>")
    rows = [(k, f"https://one.example/{k}", copied) for k in range(8)] + [(10 + k, f"https://one.example/m{k}", most(k)) for k in range(6)]
    rows += [(100 + k, f"https://two.example/{k}", few(k) if k < 5 else page(f"<p>Other {k}</p>")) for k in range(600)]
    got = extract(spark, rows)
    assert {got[k].text for k in range(8)} == {"Head First part of it. One Two Second part."}
    assert got[12].text == "A long text that is nearly all of these pages 2"
    assert got[103].text == "A heading that few share Own and longer text of page 3 here"


def test_html_copied_articles_stay(spark):
    parts = "<h1>Same</h1><p>A sentence that many pages share.</p><div class='x'>a box in it</div><section><h2>Part</h2><ul><li>one</li><li>two</li></ul></section><table><tr><td>c</td></tr></table>"
    bodies = [f"<article>{parts}</article>", f"<form action='/'><main>{parts}</main></form>", f"<nav>menu</nav><div class='ad'>buy</div><article>{parts}</article><aside>other</aside>"]
    rows = [(10 * k + n, "https://one.example/p", page(body + f"<footer>{n}</footer>")) for k, body in enumerate(bodies) for n in range(8)]
    got = extract(spark, rows)
    assert {r.text for r in got.values()} == {"Same A sentence that many pages share. a box in it Part one two c"}


def test_html_template_within_articles_goes(spark):
    made = lambda k: page(f"<article><h1>Head {k}</h1><p>A sentence that many pages share.</p><p>Long own text of page number {k}, longer than the others</p><div>Read on: <a>more</a></div></article>")
    got = extract(spark, [(k, "https://one.example/p", made(k)) for k in range(6)])
    assert got[2].text == "Head 2 A sentence that many pages share. Long own text of page number 2, longer than the others" and got[2].n_template == 1


def test_html_names_hide_no_part_of_an_article():
    text = lambda body: html_extract.parse(page(body))[0]
    assert text("<article><div class='social-policy'>a</div><p class='notice-period'>b <span class='share'>c</span></p><div class='ad'>d</div></article>") == ["a", "b c"]
    assert text("<div class='page-header-wrapper'><article>a</article></div><p>b</p>") == ["a"]
    assert text("<section class='related'><article>a</article></section><p>b</p>") == ["b"]
    assert text("<form><p>all of it</p></form>") == ["all of it"] and text("<p>a</p><form><p>b</p></form>") == ["a"]


def test_html_broken_markup():
    text = lambda body: html_extract.parse(body)[0]
    assert text('<p>a <a href="x>said</a> and <a href="y">more</a>') == ["a said and more"]
    assert text('<p title="a<b>c">q<p>r</b>s') == ["q", "rs"] and text("a<svg>b") == ["ab"] and text("<p>a<!-- b") == ["a"]


def test_html_takes_linear_time():
    import time

    for piece in ("<b>", "<i>x</p>", "<div>", "<p>a<svg>", '<a href="', "<p>x</b>", "<ul><li>"):
        began = time.perf_counter()
        html_extract.parse(piece * (200_000 // len(piece)))
        assert time.perf_counter() - began < 5


def brute_pages(rows, min_pages, min_share):
    """Texts with templates counted per host in plain Python."""
    parsed = [(i, (url or "").split("/")[2] if url else "", *html_extract.parse(h or "")) for i, url, h in rows]
    seen, contents = {}, {}
    for _, host, blocks, spans in parsed:
        contents.setdefault(host, set()).add(tuple(blocks))
        for h, outside, _, _ in spans:
            seen.setdefault((host, h), set()).add(outside)
    out = []
    for i, host, blocks, spans in parsed:
        gone = {h for h, _, _, _ in spans if len(seen[host, h]) >= max(min_pages, min_share * len(contents[host]))}
        cut = {k for h, _, a, b in spans if h in gone for k in range(a, b)}
        out.append((i, " ".join(x for k, x in enumerate(blocks) if k not in cut)))
    return sorted(out, key=str)


def test_html_against_brute_force(spark):
    real = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    boxed = [(10_000 + k, f"https://h{k % 3}.example/{k}", page(f"<div>Box {k % 4} of the site</div><p>Own text of page {k // 2}</p><ul><li>same</li></ul>")) for k in range(90)]
    rows = [*real, *boxed, (None, None, None), (20_000, "https://h0.example/", "x" * 500_000), boxed[0]]
    docs = spark.createDataFrame([(*r, "h", "b", 1) for r in rows], "page_id long, url string, html string, host string, blocks string, row long")
    for limit in (html_extract.BROADCAST_TEMPLATES, 0):
        got = html_extract.extract_text(docs, 5, 0.2, broadcast_templates=limit).collect()
        assert sorted(((r.page_id, r.text) for r in got), key=str) == brute_pages(rows, 5, 0.2)
        assert sum(r.n_template for r in got) > 90 and all(r.n_chars == len(r.text) for r in got)


def test_html_reader_comments_go(spark):
    body = page("<article class='post ad-free-not'><p>Text.</p></article><article class='comment'><p>First!</p></article>")
    assert extract(spark, [(1, "http://a/x", body)])[1].text == "Text."


def test_html_empty_table(spark):
    assert extract(spark, []) == {}


ITEMS = [
    (1, "A train leaves the old station at 40 km per hour and meets Anna after 3 hours on the long bridge near the river."),
    (2, "The quick brown fox jumps over the lazy dog while seven small birds watch from the tall green tree."),
    (3, "too short"), (4, None), (None, "no id here at all"), (5, ""),
]


def leaks(spark, frame, texts):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {r.doc_id: r for r in decontaminate.decontaminate(frame(texts), bench).collect()}


def test_leaks_are_found(spark, frame):
    filler = "Some other words come before this part. "
    texts = [
        (1, filler + ITEMS[1][1] + " And after."), (2, filler + ITEMS[1][1].upper()), (3, filler), (4, None), (5, ""),
        (6, filler + ITEMS[0][1].replace("40", "75").replace("3 hours", "9 hours").replace("Anna", "Maria")),
        (7, filler + ITEMS[0][1]), (8, "the lazy dog while seven small"), (9, "This is too short to tell."), (None, ITEMS[1][1]),
    ]
    got = leaks(spark, frame, texts)
    assert got[1].item_ids == [2] == got[1].exact_ids and got[2].item_ids == [2] and got[None].item_ids == [2]
    assert got[6].item_ids == [1] and got[6].exact_ids == []
    assert got[7].item_ids == [1] == got[7].exact_ids
    assert not any(got[k].contaminated for k in (3, 4, 5, 8)) and got[9].item_ids == [3]


def test_inconsistent_values_are_no_leak(spark, frame):
    items = [(1, "take 5 apples then add 5 pears and give 5 plums to the nice man at the gate")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, items[0][1].replace("5", "8")), (2, "take 5 apples then add 6 pears and give 7 plums to the nice man at the gate")]
    got = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(frame(texts), bench).collect()}
    assert got == {1: True, 2: False}


def test_names_where_a_sentence_begins_and_copies_in_other_case(spark, frame):
    items = [
        (1, "Natalia sold 48 clips. Natalia then sold half as many. How many did Natalia sell?"),
        (2, "In spring the old teacher Anna met her friend Peter near the river"), (3, "Natalia sold 48 clips"), (4, "Paris is"),
        (5, 'He said: "Boris has  Carla on the list" (Boris left).'),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    renamed = items[0][1].replace("Natalia", "Maria").replace("48", "62")
    texts = [
        (1, renamed), (2, "Filler before.\n" + renamed), (3, items[1][1].lower()), (4, items[1][1].upper()), (5, "Maria sold 7 clips"), (6, "London is a town. It is old."),
        (7, items[4][1].replace("Boris", "Igor").replace("Carla", "Vera")), (8, "Maria sold 62 clips. Helen then sold half as many. How many did Natalia sell?"), (9, "they are in paris is it"),
    ]
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(frame(texts), bench).collect()}
    assert 1 in got[1] and 1 in got[2] and got[3] == got[4] == [2] and got[5] == [3] and got[6] == [] and got[7] == [5]
    assert 1 not in got[8] and got[9] == [4]


def test_values_must_agree_over_the_whole_item(spark):
    items = [(1, "take 5 apples then add 5 pears and give 5 plums to the nice man at the gate of the old town near the river")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    moved = items[0][1].replace("5 apples", "6 apples").replace("and give 5", "and now give 7")  # a word put in, so on another diagonal
    texts = [(1, moved), (2, moved.replace("7", "6").replace("add 5", "add 6")), (3, items[0][1].replace("5", "forty").upper() + "\n" + items[0][1].replace("5", "1,000"))]
    got = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == {1: False, 2: True, 3: True}


def brute_leaks(docs, items):
    """doc ids -> items held, word by word in plain Python."""
    import regex

    unit, number = "|".join(decontaminate.UNITS), "|".join(decontaminate.NUMBERS)

    def words(text):
        text = regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}\p{L}*", lambda m: "§s" + m[0], (text or "").replace("§", " "))
        text = regex.sub(rf"[0-9]+(?:[.,:/][0-9]+)*|(?:§s|(?<![\p{{L}}\p{{N}}§]))(?i:{number})(?![\p{{L}}\p{{N}}])", lambda m: f" §n{m[0]} ", text)
        text = regex.sub(rf"(§n\S+)\s+(?:§s)?((?i:{unit}))\b", r"\1 §u\2", text).lower().replace("§n§s", "§n")
        return regex.findall(r"§n[0-9]+(?:[.,:/][0-9]+)*|[\p{L}\p{N}§]+", text)

    def template(own, names):
        return [w if w[0] != "§" else w[2:] if w[1] == "s" and not names else w[:2] for w in own]

    def held(doc, item):
        own = min(5, len(item))
        n, covered = len(item) - own + 1, set()
        for names in (False, True):
            a, b, lines = template(item, names), template(doc, names), {}
            if names and not any(w.startswith("§s") for w in doc) or names and not any(w.startswith("§s") for w in item):
                continue
            places = {}
            for k in range(len(b) - own + 1):
                places.setdefault(tuple(b[k : k + own]), []).append(k)
            for i in range(n):
                if not names or sum(w[0] != "§" for w in item[i : i + own]) >= 2:
                    for k in places.get(tuple(a[i : i + own]), ()):
                        lines.setdefault(k - i, set()).add(i)
            groups = []
            for d in sorted(lines):
                if groups and d - groups[-1][-1] <= 1 + n / 4:
                    groups[-1].append(d)
                else:
                    groups.append([d])
            for group in groups:
                chosen = {}
                for d in sorted(group, key=lambda d: (-len(lines[d]), d)):
                    for i in lines[d]:
                        chosen.setdefault(i, d)
                told = {(x, y) for i, d in chosen.items() for x, y in zip(item[i : i + own], doc[i + d : i + d + own], strict=True) if x[0] == "§" and (x[1] in "nu" or names)}
                told = {tuple(regex.sub("[.,:/]", "", w) for w in p) for p in told}
                if len({x for x, _ in told}) == len(told):
                    covered |= set(chosen)
        return bool(item) and 100 * len(covered) >= 75 * n

    wanted = {i: words(t) for i, t in items}
    return {i: sorted(j for j, w in wanted.items() if held(words(t), w)) for i, t in docs}


def test_leaks_against_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    named = [(9001, "Anna sold 48 clips in April. Then Anna sold half as many clips to Peter in May. How many clips did Anna sell to Peter?"), (9002, "A tank holds 40 km of pipe and twenty km of rope when 5 men work for 3 hours on it.")]
    texts = [t for _, t in named] + [t for _, t in items[:20]]
    variants = [t.upper() for t in texts] + [t.lower() for t in texts] + [t.replace("Anna", "Eve").replace("48", "forty").replace("40", "1,500").replace("twenty", "20") for t in texts]
    variants += [t.replace("Anna sold half", "Ruth sold half") for t in texts] + ["before. " + " ".join(t.split()[: 2 * len(t.split()) // 3]) for t in texts] + [t.replace(" ", "  very ", 1) for t in texts] + [" x ".join([t, t]) for t in texts]
    docs += [(100_000 + k, f"Some words. {t}\nAnd more of them.") for k, t in enumerate(variants)] + [(200_000, "word " * 200_000)]
    wide = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, pos int, h long, item_id string")
    kind = "item_id string" if isinstance(items[0][0], str) else "item_id long"
    items = [*items, *((str(i), t) if "string" in kind else (i, t) for i, t in named)]
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.decontaminate(wide, spark.createDataFrame(items, f"{kind}, text string")).collect()}
    assert got == brute_leaks(docs, items)
    assert sum(map(bool, got.values())) > len(texts) * 4


def test_leaks_empty(spark, frame, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.decontaminate(frame([(1, "some words here")]), bench).collect()] == [False]
    assert decontaminate.decontaminate(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c.txt", "no word of it"), (3, "a/b/d/LICENSE.txt", gpl), (4, "a/b/d/e.txt", "other"), (5, "x/y.txt", "nothing"), (6, "x/z.txt", f"text\nmore\nlines\n{gpl}\nend"),
        (7, None, "nothing"), (8, "x/n.txt", None), (9, "x/e.txt", ""), (10, "a/q.txt", "All rights reserved.\nwords\nwords\nwords"), (2, "a/b/c.txt", "no word of it"),
    ]
    got = {r.doc_id: (r.license, r.origin) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "file") and got[2] == ("MIT", "inherited") and got[3] == ("GPL-3.0", "file") and got[4] == ("GPL-3.0", "inherited")
    assert got[5] == (None, None) and got[6] == ("GPL-3.0", "header") and got[7] == (None, None) == got[8] == got[9] and got[10] == ("Proprietary", "header")
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string")).collect() == []


def test_secrets(spark, frame, empty):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f9%02d"
    words = ["unverhältnismäßigkeitsgrundlage internationalizations", "antidisestablishmentarianism counterrevolutionaries"]
    texts = [(k, f'some text token = "{key % k}" and more') for k in range(20)] + [(100 + k, f"words {words[k % 2]} more words {k}") for k in range(20)]
    texts += [(200, None), (201, ""), (None, f'token = "{key % 77}"'), (3, texts[3][1])]
    got = secret_scan.scan_secrets(frame(texts)).collect()
    found = {(r.doc_id, r.start, r.n_chars, r.is_secret) for r in got}
    assert {(k, 19, 40, True) for k in range(20)} <= found and (None, 9, 40, True) in found
    assert not any(r.is_secret for r in got if r.doc_id is not None and r.doc_id >= 100)
    assert sum(r.doc_id == 3 for r in got) == 1
    assert secret_scan.scan_secrets(empty).collect() == []


def test_secret_candidates_equal_a_plain_search(spark):
    import regex as re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.start, r.value) for r in secret_scan.candidates(docs, "doc_id", "text", "source").collect()}
    assert got == {(d.doc_id, m.start(), m.group()) for d in docs.collect() for m in re.finditer(secret_scan.CANDIDATE, d.text or "")}


def finding(k):
    """A text with one candidate, its place, its path and whether it is a secret: what tells is words near it, path and characters."""
    import random

    rng = random.Random(k)
    chars, secret = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rng.randint(22, 40))), k % 3 > 0
    lead, path = (f"the login {rng.choice(['secret', 'credential'])} of the service is ", f"src/deploy/conf{k % 5}.env") if secret else (f"the build {rng.choice(['digest', 'checksum'])} of the file is ", f"docs/test/log{k % 5}.lock")
    return f"{lead}{chars} and more text", len(lead), path, int(secret)


def test_secrets_learned_from_labelled_findings(spark):
    cases = [finding(k) for k in range(240)]
    docs = spark.createDataFrame([(k, t, p, 1, "label") for k, (t, _, p, _) in enumerate(cases)], "doc_id long, text string, source string, start int, label string")
    judged = spark.createDataFrame([(k, s, y, "x") for k, (_, s, _, y) in enumerate(cases) if k < 120] + [(1, cases[1][1], 1, "twice")], "doc_id long, start long, label int, text string")
    got = {(r.doc_id, r.start): r.is_secret for r in secret_scan.scan_secrets(docs, judged).collect()}
    held = [(got[k, s], y) for k, (_, s, _, y) in enumerate(cases) if k >= 120]
    true = sum(g and y for g, y in held)
    assert true >= 0.95 * sum(g for g, _ in held) and true >= 0.95 * sum(y for _, y in held) and len(held) == 120


def test_secret_candidates_of_any_length_after_a_word_for_secrets(spark):
    texts = [(1, 'password = "hunter2!" and pwd: abc, then'), (2, "api_key='a.b:c$d' token eyJhbGciOiJIUzI1NiIsInR5.eyJzdWIiOiIx.sig"), (3, "monkey: banana is no key"), (4, "x" * 300_000), (4, "x" * 300_000), (None, 'secret:"s"')]
    docs = spark.createDataFrame([(i, t, None, "v") for i, t in texts], "doc_id long, text string, source string, value string")
    got = {(r.doc_id, r.start, r.value[:40]) for r in secret_scan.candidates(docs, "doc_id", "text", "source").collect()}
    assert got == {(1, 12, "hunter2!"), (1, 31, "abc"), (2, 9, "a.b:c$d"), (2, 24, "eyJhbGciOiJIUzI1NiIsInR5.eyJzdWIiOiIx.si"), (3, 8, "banana"), (4, 0, "x" * 40), (None, 8, "s")}
    assert len(secret_scan.scan_secrets(docs).collect()) == 7


def test_licenses_in_wrapped_headers_and_whole_files(spark):
    """Notices wrapped over comment lines, whole license files, SPDX tags; the texts are wrapped and decorated as files have them."""
    import textwrap

    ls = license_scan

    def comment(text, mark):
        return "\n".join(f"{mark} {x}".rstrip() for x in ["Copyright (C) 2021 Some One", "", *textwrap.wrap(text, 68)])

    def paragraphs(*parts):
        return "\n\n".join("\n".join(textwrap.wrap(x, 72)) for x in parts)

    code = "\n\nint main(void) { return 0; }\n" + "\n".join(f"x{k} = {k};" for k in range(30))
    bsd2, bsd3 = [ls._BSD, ls._BSD_1, ls._BSD_2, ls._BSD_AS_IS], [ls._BSD, ls._BSD_1, ls._BSD_2, ls._BSD_3, ls._BSD_AS_IS]
    year = "Copyright (c) 2020, Some One. All rights reserved."
    cases = [
        ("gpl/a.py", comment(ls._gnu("General Public License", 3), "#") + code, "GPL-3.0", "header"), ("old/a.py", comment(ls._gnu("General Public License", 2), "#") + code, "GPL-2.0", "header"),
        ("lgpl/a.c", comment(ls._gnu("Lesser General Public License", 3), " *") + code, "LGPL-3.0", "header"), ("apache/a.c", comment(ls._APACHE, " *") + code, "Apache-2.0", "header"),
        ("bsd/a.c", comment(" ".join(bsd3), "//") + code, "BSD-3-Clause", "header"), ("tag/a.rs", "// SPDX-License-Identifier: MIT" + code, "MIT", "header"), ("tag/b.rs", "// SPDX-License-Identifier: Apache-2.0" + code, "Apache-2.0", "header"),
        ("two/LICENSE", paragraphs(year, *bsd2), "BSD-2-Clause", "file"), ("three/LICENSE", paragraphs(year, *bsd3), "BSD-3-Clause", "file"), ("three/src/a.c", code, "BSD-3-Clause", "inherited"),
        ("mit/LICENSE", paragraphs("MIT License", "Copyright (c) 2020 Some One", ls._MIT, ls._MIT_NOTICE, ls._AS_IS), "MIT", "file"), ("isc/COPYING", paragraphs("Copyright (c) 2020, Some One", ls._ISC, ls._ISC_AS_IS), "ISC", "file"),
        ("ap/LICENSE", "                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n", "Apache-2.0", "file"),
        ("none/a.c", "/* Copyright (c) 2020 Some One */" + code, None, None), ("long/a.txt", "word " * 200_000 + "\nword\nword\nReleased under the MIT License.", "MIT", "header"),
    ]
    rows = [(k, path, text, k) for k, (path, text, _, _) in enumerate(cases)]
    got = {r.path: (r.license, r.origin) for r in ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string, license long")).collect()}
    assert got == {path: (name, origin) for path, _, name, origin in cases}
