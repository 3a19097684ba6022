"""Each operator on small input: nulls, empty and long texts, ties, repeats, empty tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from spinneret.llm import (
    decontaminate,
    html_text,
    licences,
    line_dedup,
    mixing,
    near_dup,
    pii,
    quality_crf,
    quality_rules,
    token_files,
)

WORDS = [a + b + c for a in ("ta", "no", "ri", "qu", "em") for b in ("la", "s", "ver") for c in ("n", "do", "th", "is")]


@pytest.fixture
def docs(spark):
    """Rows with columns beside their own whose names operators use."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, s, 0, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, target string"
        )

    return make


def text(seed, n, line=12):
    pick = random.Random(seed)
    found = [pick.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(found[i : i + line]) for i in range(0, n, line))


ODD = [(None, None, None), (1, None, "a"), (2, "", None), (3, " \t\n", "b"), (3, " \t\n", "b"), (None, text(1, 60), "a")]


def collected(df):
    return [r.asDict() for r in df.collect()]


# Quality rules


def base_counts(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered)


def test_quality_rules(spark, docs):
    rows = ODD + [(10 + i, text(i, 40 + 30 * i) + (" a b c d\na b c d" * (i % 3)) + " x#|é" * i, "s") for i in range(8)]
    rows.append((50, "word " * 30_000, "s"))
    df = docs(rows)
    trusted = spark.createDataFrame([(10,), (11,), (None,)], "doc_id long")
    found = collected(quality_rules.quality_rules(df, trusted))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in found)
    assert got == sorted((str(i), *base_counts(t or "")) for i, t, _ in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    none = collected(quality_rules.quality_rules(df, trusted.limit(0)))
    assert {r["score"] for r in none} == {0.0}
    assert quality_rules.quality_rules(df.limit(0), trusted).count() == 0


def test_quality_scores_by_brute_force(spark, docs):
    rows = [(i, text(i, 20 + i), "s") for i in range(6)]
    counts = quality_rules.ngram_counts(docs(rows), spark.createDataFrame([(0,), (1,)], "doc_id long"), 64).collect()
    grams = sum(2 * (20 + i) - 1 for i in range(6))
    assert sum(r["raw"] for r in counts) == grams
    assert sum(r["target"] for r in counts) == 39 + 41


# Pages


def test_html_text(spark):
    page = (
        '<html><body><nav><a>menu</a></nav><div class="cookie-notice">we use</div><article class="post"><h1>A &amp; B</h1>'
        "<p>one\n <b>two<br>three<p>four <script>x<y</script>&nbsp;five</p><div class='share'>tweet</div>"
        "<section class=comments><p>reader</p></section></article><aside>side</aside><footer>foot</footer></body></html>"
    )
    rows = [(1, "http://h/1", page, "x"), (2, None, None, "x"), (None, "http://h/2", "", "x"), (3, "u", "plain < text", "x")]
    rows += [(4, "http://h/1", page, "x"), (5, "h", "<p>" * 20_000, "x"), (6, "h", '<a b="' * 20_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert found[1] == found[4] == "A & B\none two three\nfour five"
    assert (found[2], found[None], found[3], found[5]) == ("", "", "plain < text", "")
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_site_parts_without_a_name_are_cut(spark):
    pages = [
        (i, f"http://h.example/{i}", f"<body><div class=x1>All rights of the site</div><div class=x2>{text(i, 30, 30)}</div></body>")
        for i in range(6)
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert found == {i: text(i, 30, 30) for i in range(6)}
    few = {r["page_id"]: r["text"] for r in html_text.extract_text(df.limit(3)).collect()}
    assert all(x.startswith("All rights") for x in few.values())


def test_copies_do_not_make_text_part_of_the_site(spark):
    def page(i):
        return f"<body><div class=x1>All rights of the site</div><div class=post><p>{text(i, 30, 30)}</p></div></body>"

    pages = [(i, f"http://h.example/{i}", page(max(i, 84))) for i in range(100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert found == {i: text(max(i, 84), 30, 30) for i in range(100)}


def test_the_tree_judges_inside_articles(spark):
    """Short lines that stand in every article go, if the tree is on; long ones and headings stay."""

    def page(i):
        return (
            f"<body><article><h1>the same title</h1><p>{text(i, 30, 30)}</p><p class=follow>follow us for more</p>"
            f"<p class=terms>{text(99, 30, 30)}</p></article></body>"
        )

    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(6)], "page_id long, url string, html string")
    on = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert on == {i: f"the same title\n{text(i, 30, 30)}\n{text(99, 30, 30)}" for i in range(6)}
    off = {r["page_id"]: r["text"] for r in html_text.extract_text(df, low=0.0).collect()}
    assert all("follow us for more" in x for x in off.values())
    # Copies of one article, whatever stands around it, are one page.
    copies = [(i, f"http://h.example/{i}", f"<body><div>{i}</div>{page(min(i, 4))}</body>") for i in range(50)]
    df = spark.createDataFrame(copies, "page_id long, url string, html string")
    assert html_text.importance(df).where("m >= 6").count() == 0


def test_importance_is_entropy_by_hand(spark):
    """Given pages, with the names of their parts taken away, judged by counting in plain Python."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plain = F.regexp_replace("html", "(</?)(?:article|nav|footer)", "$1div")
    df = df.select("page_id", F.concat(F.lit("http://h"), (F.col("page_id") % 3).cast("string")).alias("url"), plain.alias("html"))
    seen, nodes = set(), {}
    for r in df.collect():
        root = html_text.parse(r["html"])
        page = (r["url"], html_text._contents(root))
        if page not in seen:
            seen.add(page)
            for path, shape, content, words in html_text.style_nodes(root):
                nodes.setdefault((r["url"][7:], path), []).append((shape, content, words))

    def entropy(values):
        shares = [values.count(x) / len(values) for x in set(values)]
        return -sum(x * math.log(x, len(values)) for x in shares) if len(values) > 1 else 1.0

    found = {(r["host"], r["path"]): (r["m"], r["importance"]) for r in html_text.importance(df).collect()}
    assert found.keys() == nodes.keys() and len(nodes) > 10
    for key, values in nodes.items():
        shape, content, words = zip(*values, strict=True)
        want = max(0.1 * entropy(shape) + 0.9 * entropy(content), min(1, sum(words) / len(values) / 50))
        assert found[key] == (len(values), pytest.approx(want, abs=1e-9))


def test_main_with_articles_in_it():
    def found(page):
        return html_text.main_text(html_text.parse(page))

    assert found("<main><p>intro</p><article>card</article><p>rest</p></main>") == "intro\ncard\nrest"
    assert found("<main><div>hero</div><article><p>one</p></article><div>next</div></main>") == "one"
    assert found("<main><p>one</p></main><article>two</article>") == "two"
    assert found("<article>two</article><main><p>one</p><article>card</article></main><p>out</p>") == "two\none\ncard"
    assert found("<main><p> </p><article>one<article>two</article></article></main>") == "one\ntwo"


def test_inline_elements_that_are_not_content_end():
    def found(page):
        return html_text.main_text(html_text.parse(page))

    assert found('<article><p>one <i class="icon" aria-hidden="true"></i>two</p><p>three</p></article>') == "one two\nthree"
    assert found('<article><span class="ad">buy <span>now</span> here</span><p>one</p><p>two</p></article>') == "one\ntwo"
    assert found('<body><a class="skip-nav" href="#x">Skip</a><div><p>one <a href="y">two</a></p></div></body>') == "one two"
    assert found('<article><a class="share">tweet<a href="y">one</a><p>two</p></article>') == "one\ntwo"
    assert found('<article><p>one <span class="ad">buy</p><p>two</span> three</p></article>') == "one\ntwo three"


def test_names_cut_no_article_and_count_whole():
    def found(page):
        return html_text.main_text(html_text.parse(page))

    article = "<article><h1>one</h1><p>two</p></article>"
    for around in ('<div class="layout with-sidebar">%s</div>', '<div id="page-no-ads">%s</div>', '<div class="search">%s</div>',
                   "<form>%s</form>", '<form><div class="social"><div>%s</div></div></form>'):
        assert found(f"<body><nav>menu</nav>{around % article}<footer>foot</footer></body>") == "one\ntwo"
    assert found("<body><form><div><p>one</p></div><nav>menu</nav></form></body>") == "one"
    assert found(f'<article><p>one</p><p class="related-work">two</p></article><div class="comments">{article}</div>') == "one\ntwo"
    for word in ("ad-slot", "site-footer", "related-posts", "skip-nav", "menu-item-12", "cookie-notice", "page__sidebar", "ad"):
        assert found(f'<article><p>one</p><div class="x {word}">two</div><form>three</form></article>') == "one"
    assert found(f"<body><p>one</p><aside>{article}</aside></body>") == "one"


# Mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, bound, fixed = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}, {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > bound[s]]
        if not over:
            return fixed | share
        fixed |= {s: bound[s] for s in over}


def test_mix_counts(docs):
    rows = [(i, text(i, 5 + i % 40), f"s{i % 4}") for i in range(120)] + [(i, text(i, 400), "big") for i in range(200, 230)]
    rows += ODD + [(9, text(9, 10), None)] * 2
    df = docs(rows)
    found = collected(mixing.mix_counts(df))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected, taken = brute_targets(dict(sizes)), collections.Counter()
    for r in found:
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["size"] * 3 >= r["taken"] >= 0
        taken[r["source"]] += r["taken"]
    for s, n in expected.items():
        assert abs(taken[s] - n) <= max([len((t or "").split()) for _, t, o in rows if o == s]) * 2
    assert sorted(map(str, found)) == sorted(map(str, collected(mixing.mix_counts(df.repartition(5)))))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    total = sum(r["taken"] for r in found)
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == total
    assert mixing.mix_counts(df.limit(0)).count() == 0


# Token files


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "Don't  STOP.,\tnow!! 42 É café", "<|endoftext|> a<|startoftext|>", "x\x0by\x85z", "long" * 30_000, "Ünï. code,"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(2, texts[2], "s"), (None, "no id", "s")]
    found = collected(token_files.encode_documents(docs(rows).repartition(4), path))
    whole, start, expected = Tokenizer.from_file(path), 0, []
    for i, t in sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert token_files.encode_documents(docs(rows).limit(0), path).count() == 0


# Licences


def test_licences(spark, docs):
    mit = licences.KNOWN[2][1]
    altered = "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,")
    rows = ODD + [(10, altered, "a"), (11, "words\nreleased under the MIT  licence\nmore", "a"), (12, mit + " and more", "a")]
    found = {r["doc_id"]: r for r in licences.licence_scan(docs(rows), licences.known_licences(spark)).collect()}
    assert found[10]["licence"] == "MIT" and found[10]["n_notices"] == 1
    assert (found[11]["licence"], found[11]["notices"], found[11]["n_notices"]) == (None, "MIT", 1)
    assert found[12]["licence"] is None and found[1]["licence"] is None
    assert set(found) == {None, 1, 2, 3, 10, 11, 12}
    assert licences.licence_scan(docs(rows).limit(0), licences.known_licences(spark)).count() == 0


def test_whole_licences_notices_and_one_row_each(spark, docs):
    known = dict(x for x in licences._whole())
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(known)
    apache = licences.resources.files(licences.__package__).joinpath("licence_texts/Apache-2.0.txt").read_text()
    isc = next(x for name, x in licences.KNOWN if name == "ISC")
    notices = {
        "GPL-2.0-or-later": "Licensed under the GNU General Public License, either version 2 or later.",
        "BSD-2-Clause": "Released under the BSD 2-Clause License", "CC-BY-4.0": "This article is licensed under CC BY 4.0",
        "CC0-1.0": "Published under CC0 1.0.", "MPL-2.0": "# SPDX-License-Identifier: MPL-2.0", "LGPL-3.0-or-later": "// SPDX-License-Identifier: LGPL-3.0+",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    rows = [(10, apache.replace("[yyyy] [name of copyright owner]", "2021 Some One"), "a"), (11, apache[: apache.index("END OF")], "a")]
    rows += [(12, "ISC License\n\nCopyright (c) 2020, Some One\n\n" + isc, "a"), (13, "\n".join(["text", *notices.values(), "text"]), "a")]
    rows += [(14, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + licences.KNOWN[2][1], "a")]
    found = licences.licence_scan(docs(rows + ODD), licences.known_licences(spark)).collect()
    assert len(found) == len(rows + ODD) and sum(r["doc_id"] is None for r in found) == 2
    by_id = {r["doc_id"]: r for r in found}
    assert [by_id[i]["licence"] for i in (10, 11, 12, 13, 14)] == ["Apache-2.0", "Apache-2.0", "ISC", None, "MIT"]
    assert by_id[13]["notices"] == ",".join(sorted(notices)) and by_id[13]["n_notices"] == len(notices)


# Personal data


def luhn(x):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(x))) % 10 == 0


def base_spans(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x):
        out += [("ip", *m.span())] * all(int(p) <= 255 for p in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] * (16 <= len(d) <= 19 and luhn(d))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        out += [("phone", *m.span())] * (8 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return ",".join("%s:%d:%d" % s for s in out)


def test_pii(docs):
    alphabet = "a1@.+- (5)é_4%\n"
    pick = random.Random(3)
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(200))) for _ in range(120)]
    texts += [
        "é mail a.b@c.d_e@f.g.h, 1.2.3.4.5.6.7.8 256.1.1.1 0000001.2.3.4 card 4111 1111-1111 1111 x +1 (555) 123-4567.",
        "IBAN DE89 3704 0044 0532 0130 00 ok, DE88 3704 0044 0532 0130 00", "card 378282246310005, no 378282246310006",
        "4111111111111111" * 3, "a" * 100_000, "1" * 100_000, "+1" * 30_000, "a@" * 30_000, "1-" * 30_000,
    ]
    rows = ODD + [(10 + i, t, "s") for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in pii.digested(pii.find_pii(docs(rows))).collect() if r["doc_id"] and r["doc_id"] >= 10}
    for i, t in enumerate(texts):
        assert found[10 + i]["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest(), t[:100]
    assert found[131]["spans"].startswith("iban:5:32") and found[131]["spans"].count("iban") == 1
    assert found[131]["scores"] == "1.0"
    assert found[132]["spans"] == "short_card:5:20"
    assert found[10 + 120]["n_phone"] == 1
    assert pii.digested(pii.find_pii(docs(rows).limit(0))).count() == 0


def test_pii_context_on_both_sides_and_in_lists(docs):
    amex = ["378282246310005", "371449635398431", "3787 344936 71000"]
    texts = [
        "Amex: " + ", ".join(amex[:2]), "3782 822463 10005 (Amex)", "cards:\n" + "\n".join(amex * 5), ", ".join(amex * 5) + " are cards",
        "order " + amex[0] + " and nothing of that kind here, " + "x" * 40 + " card", "mail " + " and ".join(f"p{i}@h.org" for i in range(9)),
        "p@gmail.com, q@h.org " + "é" * 41 + " mail", "fax +1 555 123 4567 / +1 555 123 4568, +44 20 7946 0000",
    ]
    rows = {r["doc_id"]: r for r in pii.digested(pii.find_pii(docs([(i, x, "s") for i, x in enumerate(texts)]))).collect()}
    assert rows[0]["spans"] == "short_card:6:21,short_card:23:38" and rows[1]["spans"] == "short_card:0:17"
    assert [rows[i]["spans"].count("short_card") for i in (2, 3, 4)] == [15, 15, 0]
    assert rows[5]["scores"] == ",".join(["0.7"] * 9) and rows[6]["scores"] == "0.5,0.5" and rows[7]["scores"] == "0.7,0.7,0.7"


# Near duplicates


def brute_groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = tuple((t or "").encode().lower().split())
        sets.append({w[i : i + k] for i in range(len(w) - k + 1)} if len(w) >= k else {w} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= percent * either:
                x, y = sorted((top(a), top(b)), key=lambda i: rows[i][0])
                parent[y] = x
    return {i: (len(s), rows[top(j)][0]) for j, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k, monkeypatch):
    monkeypatch.setattr(near_dup, "CELL", 4)
    rows, pick = [(900, None), (901, ""), (902, " \n")], random.Random(5)
    for i in range(12):
        rows.append((i, text(i, 60)))
    for i in range(12, 70):
        words = text(i % 3, 60).split()
        for _ in range(pick.randrange(8)):
            words[pick.randrange(len(words))] = pick.choice(WORDS).upper()
        rows.append((i, " ".join(words)))
    rows += [(100, "one"), (101, "ONE"), (102, "one two"), (103, "x " * 20_000)]
    found = near_dup.near_duplicates(docs([(i, t, "s") for i, t in rows]), k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute_groups(rows, k, 80)
    kept = near_dup.without_near_duplicates(docs([(i, t, "s") for i, t in rows + rows[3:9]]), k)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["doc_id"] for r in found.where("kept").collect()})


def test_near_duplicates_without_ids(docs):
    found = collected(near_dup.near_duplicates(docs(ODD)))
    assert len(found) == len(ODD)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None, None]
    assert near_dup.without_near_duplicates(docs(ODD)).count() == 5
    assert near_dup.near_duplicates(docs(ODD).limit(0)).count() == 0


@pytest.fixture
def sixteen_partitions(spark):
    """Shuffles into 16 partitions that Spark does not join, however small."""
    ours = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_near_duplicates_write_narrow_tables_in_few_files(docs, monkeypatch, sixteen_partitions):
    tables = collections.defaultdict(list)

    def noting(f):
        def noted(df, label):
            out = f(df, label)
            tables[label].append(len((out[0] if isinstance(out, tuple) else out).inputFiles()))
            return out

        return noted

    for name in ("written", "written_counted"):
        monkeypatch.setattr(near_dup, name, noting(getattr(near_dup, name)))
    rows, pick = [], random.Random(7)
    for i in range(120):
        words = text(i % 30, 60).split()
        for _ in range(i // 30 * 2):
            words[pick.randrange(len(words))] = pick.choice(WORDS).upper()
        rows.append((i, " ".join(words)))
    kept = near_dup.without_near_duplicates(docs([(i, t, "s") for i, t in rows]), 2)
    top = brute_groups(rows, 2, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in rows if top[i][1] == i]
    for label in ("near-pairs", "near-split", "near-families", "near-found", "near-first", "near-twins"):
        assert max(tables[label]) <= 1, label
    assert tables["near-links"][0] == 1
    assert max(tables.get("near-cells", [0])) <= 1


def test_sketches_fill_and_estimate():
    sets = [np.unique(near_dup.mixed(np.arange(1, n + 1, dtype=np.uint64))) for n in (1, 3, 1000, 800)]
    found = near_dup.sketches(sets, 160)
    assert (found != np.iinfo(np.uint64).max).all()
    assert abs((found[2] == found[3]).mean() - 0.8) < 0.12


# Decontamination


def test_leaks(spark, docs):
    items = [(i, text(1000 + i, 20 + 3 * i, 99)) for i in range(12)]
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "...")], "item_id long, text string")
    altered = items[5][1].split()
    altered[4:6] = ["other", "words", "here"]
    rows = ODD + [(100 + i, text(i, 300), "s") for i in range(30)]
    rows += [(200, text(50, 100) + "\n" + items[2][1].upper() + ".\n" + text(51, 700), "s"), (201, items[7][1], "s")]
    rows += [(202, text(52, 77) + " " + " ".join(altered) + " " + text(53, 90), "s"), (201, items[7][1], "s")]
    found = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(rows), benchmark).collect()]
    assert sorted(found) == [(200, 2), (201, 7), (201, 7), (202, 5)]
    clean = decontaminate.without_leaks(docs(rows), benchmark)
    assert clean.columns == docs(rows).columns
    assert clean.count() == len(rows) - 4
    assert decontaminate.find_leaks(docs(rows).limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(docs(rows), benchmark.limit(0)).count() == 0


# Lines


def test_line_dedup(docs):
    passage = text(77, 120)
    rows = ODD + [(10 + i, text(100 + i, 96) + "\n" + passage + "\n" + text(200 + i, 72), "s") for i in range(5)]
    rows += [(30, text(300, 200), "s"), (31, "tiny\nlines", "s"), (32, "tiny\nlines", "s"), (33, passage, "s"), (33, passage, "s")]
    df = docs(rows)
    found = collected(line_dedup.dedup_lines(df))
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[10]["n_removed"] == 0 and by_id[10]["text"] == rows[len(ODD)][1]
    for i in range(11, 15):
        assert by_id[i]["n_removed"] >= 4
        lines, gone = rows[len(ODD) + i - 10][1].split("\n"), set()
        for run in by_id[i]["removed"].split(","):
            begin, end = map(int, run.split(":"))
            gone |= set(range(begin, end))
        assert all(lines[j] in passage for j in gone)
        assert by_id[i]["text"] == "\n".join(x for j, x in enumerate(lines) if j not in gone)
    assert by_id[30]["n_removed"] == by_id[32]["n_removed"] == 0
    assert len(found) == len(rows) and line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert by_id[1]["text"] is None and set(by_id[1]) == {*df.columns, "n_lines", "n_removed", "removed"}


def test_line_dedup_finds_all_runs_of_50_words(docs):
    # Passages of 2 to 5 lines under 50 words, each time between other lines.
    passages = [text(700 + i, n * words, words).split("\n") for i, (n, words) in enumerate([(2, 30), (3, 20), (4, 15), (5, 11)] * 6)]
    around = [[text(1000 * at + 10 * i, 24).split("\n"), text(1000 * at + 10 * i + 5, 36).split("\n")] for at in (1, 2, 3) for i in range(24)]
    rows = [(i, "\n".join(around[i][0] + passages[i % 24] + around[i][1]), "s") for i in range(72)]
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(rows)).collect()}
    for i in range(72):
        assert found[i]["removed"] == ("" if i < 24 else f"2:{2 + len(passages[i % 24])}"), i


# Quality classifier


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    starts, step = np.array([0, 3, 4]), rng.normal(size=(2, 2))
    emit = rng.normal(size=4)
    good, steps, _ = quality_crf._marginals(emit, step, starts)
    weights = {}
    for a in range(2):
        for b in range(2):
            for c in range(2):
                weights[a, b, c] = np.exp(emit[:3] @ np.array([a, b, c]) + step[a, b] + step[b, c])
    total = sum(weights.values())
    for i in range(3):
        assert good[i] == pytest.approx(sum(v for k, v in weights.items() if k[i]) / total)
    assert good[3] == pytest.approx(1 / (1 + np.exp(-emit[3])))
    assert steps.sum() == pytest.approx(2)


def test_classifier_separates_held_out_rows(spark, docs):
    rows = [(i, text(i, 60), "s") for i in range(150)] + [
        (i, "\n".join("|".join(x.upper().split()) for x in text(i, 60).split("\n")), "s") for i in range(150, 300)
    ]
    df = docs(rows + ODD)
    labels = spark.createDataFrame([(i, int(i < 150), "x") for i in range(300)] + [(None, 1, "x")], "doc_id long, quality int, score string")
    model = quality_crf.train(df, labels, 200)
    found = collected(quality_crf.score_documents(df, model))
    assert len(found) == len(rows) + len(ODD)
    held = [r for r in found if r["held_out"] and r["doc_id"] > 3]
    assert len(held) > 30 and all(r["predicted"] == int(r["doc_id"] < 150) for r in held)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in found if r["doc_id"] is not None)
    empty = quality_crf.score_documents(df, quality_crf.train(df, labels.limit(0)))
    assert {round(r["score"], 6) for r in empty.collect()} == {0.5}
    assert quality_crf.score_documents(df.limit(0), model).count() == 0


def test_registered_without_oracle_are_named():
    import __spark_entry__ as entry

    assert {f"op{i}_" for i in range(1, 11)} == {re.match(r"op\d+_", x)[0] for x in entry.queries() if re.match(r"op\d+_", x)}


# Rows without an id or with a repeated one, names of columns, long texts


def test_near_duplicates_keep_every_text_once(spark):
    a, b, c, d, e = (text(100 + i, 80) for i in range(5))
    rows = [(7, a, 0), (None, a, 0), (None, a, 0), (None, b, 0), (None, b, 0), (9, c, 0), (9, d, 0), (9, d, 0), (None, e, 0)]
    rows += [(5, " \n", 0), (5, " \n", 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _turn int").selectExpr("*", "1 AS _kept_id", "2 AS row", "3 AS mark")
    kept = near_dup.without_near_duplicates(df)
    assert kept.columns == df.columns
    got = collected(kept)
    assert {(r["_turn"], r["_kept_id"], r["row"], r["mark"]) for r in got} == {(0, 1, 2, 3)}
    words = sorted((r["text"] for r in got if r["text"] and r["text"].strip()))
    assert words == sorted([a, b, c, d, e])
    assert {r["doc_id"] for r in got if r["text"] in (a, c, d)} == {7, 9}
    assert len(got) == 5 + 2


def test_sets_of_rows_without_an_id_are_read_once(spark):
    rows = [(None, text(i, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = near_dup.sketched(df, 2, 32, 5)
    nodes = sketch.groupBy("node").agg(near_dup.F.min(near_dup.F.struct("doc_id", "mark")).alias("place"))
    assert near_dup._full_sets(df, nodes, 2).count() == 60
    joined = near_dup._marked(df).alias("d").join(
        nodes.select("place.*").alias("p"), near_dup.F.expr("d.doc_id <=> p.doc_id AND d.mark = p.mark")
    )
    assert joined.count() == 60


def test_mixing_rows_without_an_id(spark):
    rows = [(None, text(i, 40), "a") for i in range(100)] + [(i, text(500 + i, 40), "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collected(mixing.mix_counts(df))
    for source in ("a", "b"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 40


def test_token_ids_equal_the_library_on_odd_words(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path) as f:
        encoder = token_files._Encoder(f.read())
    pick = random.Random(8)
    letters = ["İ", "ı", "ß", "Å", "É", "é", "é", "中", "ﬁ", "K", "a", "B", "z", "٣", "ǅ", "ς", "🙂", " ", " ", "\x00"]
    marks = [",", ".", "!?", ";:", "'", "-", "́", "...", "\"", ""]
    texts = ["İ,", "İ!?", "İ.", "x" * 5000, "中" * 3000 + ","]
    for _ in range(4000):
        words = ["".join(pick.choice(letters) for _ in range(pick.randrange(1, 5))) + pick.choice(marks) for _ in range(3)]
        texts.append(pick.choice([" ", "\n", "\t ", "  "]).join(words))
    for x in texts:
        want = np.array(library.encode(x, add_special_tokens=False).ids, "<i4").tobytes()
        assert encoder.encode(x) == want, x
    assert max(map(len, encoder)) <= token_files._LONGEST


def test_pii_in_texts_of_many_matches(docs):
    pick = random.Random(4)
    parts = [pick.choice(["10.0.0.1", "a@b.co", "12", "4111 1111 1111 1111", "+44 20 7946 0018", "word", "é"]) for _ in range(3000)]
    long = ", ".join(parts)
    (row,) = collected(pii.find_pii(docs([(1, long, "a")])))
    for kind, found in (("email", "a@b.co"), ("ip", "10.0.0.1")):
        want, at = [], 0
        while (at := long.find(found, at)) >= 0:
            want.append((at, at + len(found)))
            at += len(found)
        assert [(s["start"], s["end"]) for s in row[kind]] == want


def test_line_dedup_compares_bytes(docs):
    """Chunks whose digests agree are the same only if their bytes are."""
    passages = ["\n".join(text(p * 10 + j, 12, 12) for j in range(6)) for p in range(12)]
    rows = [(i, "\n".join((text(1000 + i, 9, 9), passages[i % 12], text(2000 + i, 9, 9))), "a") for i in range(30)]
    df = docs(rows)
    want, few = (sorted(collected(line_dedup.removable(df, digest_bits=b)), key=repr) for b in (64, 3))
    assert want and few == want


def test_line_dedup_keeps_columns_and_refuses_its_own_names(spark):
    df = spark.createDataFrame([(1, "a\nb", 5)], "doc_id long, text string, _lines int").selectExpr("*", "7 AS row", "8 AS id", "9 AS th")
    (row,) = collected(line_dedup.dedup_lines(df))
    assert (row["_lines"], row["row"], row["id"], row["th"], row["text"], row["n_lines"]) == (5, 7, 8, 9, "a\nb", 2)
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.dedup_lines(df.withColumnRenamed("_lines", "n_lines"))


def test_word_hashes_hold_a_bounded_number_of_words(monkeypatch):
    from spinneret.llm import common

    monkeypatch.setattr(common, "_REMEMBERED", 100)
    words = decontaminate._Words()

    def numbers(found):
        return words.of(pa.array(found, pa.binary()).cast(pa.string(), safe=False)).tolist()

    numbers([b"-" * (i % 60 + 1) + b"%d" % (i % 7) * (i % 2) for i in range(5000)])
    numbers([b"x" * 1000, b"-" * 1000, *[("é%d" % i * j).encode() for i in range(300) for j in (1, 40)]])
    assert len(words) <= 100 and max(map(len, words)) <= 64
    for word in (b"It's", b"--", b"A1b2", "Straße,".encode(), "don’t".encode(), b"...", b"\xff\xfe", b"", "…".encode()):
        want = "".join(filter(str.isalnum, word.decode("utf-8", "replace").casefold())).encode()
        found = numbers([b"a", word, b"b", want])
        assert found[1] == found[3] and (found[1] == 0) == (not want) and len({found[0], found[1], found[2]}) == 3


def test_words_are_told_apart():
    pick = random.Random(5)
    many = list({"".join(pick.choices("abcABC12é-.", k=pick.randrange(1, 12))) for _ in range(30_000)})
    plain = ["".join(filter(str.isalnum, x.casefold())) for x in many]
    found = decontaminate._Words().of(pa.array(many, pa.string())).tolist()
    by = {}
    for x, number in zip(plain, found, strict=True):
        assert by.setdefault(x, number) == number
    # 32 bits: a collision among so few is one in many runs.
    assert len(by) - len(set(by.values())) <= 1
    whole = decontaminate._Words().each(pa.array(["x ".join(many[:500]), None, "A a"], pa.string()))
    assert [len(x) for x in whole][1:] == [0, 2] and whole[2][0] == whole[2][1]


def test_words_of_short_characters_skip_the_library(monkeypatch):
    library, through = decontaminate._Words.hashed, []
    monkeypatch.setattr(decontaminate._Words, "hashed", staticmethod(lambda word: through.append(word) or library(word)))
    pick = random.Random(6)
    latin = ["".join(pick.choices("abZ09-.'éÉßñжЖµº\u0085", k=pick.randrange(1, 9))) for _ in range(3000)]
    words = decontaminate._Words()
    found = words.each(pa.array([" ".join(latin), "É" * 70_000 + " é"], pa.string()))
    assert not through
    every = words.of(pa.array([*latin, "é" * 70_000, "é"], pa.string()))
    assert np.concatenate(found).tolist() == every[every != 0].tolist() and len(found[1]) == 2


def test_words_of_any_bytes_have_the_same_numbers():
    pick = random.Random(7)
    some = [pick.choices(b"Aa.\xc3\xa9\xc2\x80\xff\xe2\x82\xac\xdf\xc0", k=pick.randrange(0, 6)) for _ in range(20_000)]
    wide = ["’".encode(), "aŉ’É".encode(), "İ".encode(), "K中".encode(), "x́".encode()]
    words = pa.array([*map(bytes, some), *wide], pa.binary()).cast(pa.string(), safe=False)
    numbers, odd = decontaminate._quick_numbers(words)
    want = decontaminate._Words().of(words)
    assert (numbers[~odd] == want[~odd]).all() and 0.1 < odd.mean() < 0.9
    assert odd[-5:].tolist() == [True, True, False, True, False]
    part = words.slice(777, 1000)
    assert (decontaminate._quick_numbers(part)[0] == numbers[777:1777]).all()


def test_grid_has_lengths_and_sums_of_passages():
    pick = np.random.default_rng(8)
    texts = [(pick.zipf(1.3, n) % 999 * 70_000_000 % 2**32).astype(np.uint32) for n in (1, 31, 32, 33, 500)]
    grid, rows = decontaminate._grid(texts, 32)
    assert rows.tolist() == [1, 1, 1, 2, 16] and (grid == decontaminate._FEATURES).sum() == 31 + 1 + 31 + 12
    idf = pick.random(decontaminate._FEATURES)
    row, feature, weight = decontaminate._weighted([x[a : a + 32] for x in texts for a in range(0, len(x), 32)], idf)
    dense = np.zeros((len(grid), decontaminate._FEATURES + 1))
    np.add.at(dense, (np.arange(len(grid))[:, None], grid), np.append(idf, 0)[grid])
    norm = decontaminate._lengths(grid, idf)
    assert np.allclose(norm, np.linalg.norm(dense, axis=1)) and np.allclose(weight, (dense / norm[:, None])[row, feature])
    source = np.zeros((decontaminate._FEATURES + 1, 3), np.float32)
    source[:-1] = pick.standard_normal((decontaminate._FEATURES, 3))
    assert np.allclose(decontaminate._row_sums(grid, source), source[grid].sum(1), atol=1e-4)


def test_latent_space_is_orthonormal_and_spans_the_leading_directions(spark):
    pick = np.random.default_rng(3)
    topics = pick.integers(0, 2**32, (6, 40)).astype(np.uint32)
    rows = [(topics[i % 6][pick.integers(0, 40, 30)].tobytes(), 1.0) for i in range(300)]
    sample = spark.createDataFrame([(bytearray(w), x) for w, x in rows], "words binary, weight double")
    space = decontaminate.latent_space(sample, np.ones(decontaminate._FEATURES), rank=6, extra=4)
    assert np.allclose(space.T @ space, np.eye(6), atol=1e-3) and not space[-1].any()
    row, feature, value = decontaminate._weighted([np.frombuffer(bytes(w), np.uint32) for w, _ in rows], np.ones(decontaminate._FEATURES))
    used = np.unique(feature)
    full = np.zeros((300, len(used)))
    full[row, np.searchsorted(used, feature)] = value
    best = np.linalg.svd(full)[1][:6]
    held = np.linalg.svd(full @ space[used])[1]
    assert (held >= 0.98 * best).all()


def test_space_is_fitted_on_all_passages(spark, docs):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(32)), "s") for i in range(120)]
    benchmark = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    hashed = decontaminate.hashed_words(docs(rows))
    _, space = decontaminate.fit_space(hashed, benchmark, 8)
    words = np.concatenate(decontaminate._Words().each(pa.array([x for _, x, _ in rows], pa.string())))
    # Weighed as eight passages, but all of them: no word is nowhere in the space.
    assert (np.linalg.norm(space[decontaminate._features(words)], axis=1) > 1e-2).all()


def test_sums_of_rows():
    pick = np.random.default_rng(7)
    source = pick.standard_normal((700, 5)).astype(np.float32)
    group = np.sort(np.minimum(pick.integers(0, 3000, 9000), pick.integers(0, 3000, 9000)) // 3 * (pick.random(9000) > 0.2))
    row = pick.integers(0, 700, 9000)
    found, sums = decontaminate._sums(group, row, source)
    want = np.zeros((group.max() + 1, 5))
    np.add.at(want, group, source[row].astype(float))
    assert sorted(found) == np.unique(group).tolist() and np.allclose(sums, want[found], atol=1e-3)


def test_latin_words_skip_the_library(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_files._Encoder(f.read())
    through, library = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda word: through.append(word) or library(word))
    every = [*token_files._LATIN, *(x + "e" + x for x in token_files._LATIN), "Ñandú,***", "ÉTÉ&&&", "Straße###", "and.%%%"]
    for x in every:
        assert encoder.encode(x) == library(x), x
    # Marks alone still go through it, once.
    assert set(through) == {",***", "&&&", "###", ".%%%"}
    for x in ("İx", "n'", "x'S", "<|endoftext|>", "a<|endoftext|>", "a\u0301.", "ﬁ", "é\xa0É."):
        assert encoder.encode(x) == library(x), x
