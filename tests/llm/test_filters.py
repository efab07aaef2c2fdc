import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, make_docs
from termweave.llm import license, lines, ordinal, pii, urls

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else 2 * int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(out)]


def test_plain_spans_equal_the_patterns(docs):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab.@1234567890 -+()@@.."), rng.integers(0, 60))) for _ in range(4000)]
    texts += [r.text or "" for r in docs.select("text").collect()]
    texts += ["1" * 20_000, "a" * 20_000 + "@", "1.2.3.4.5.6.7.8", "a@b.c@d.e"]
    for t in texts:
        assert pii.plain_spans(t) == plain(t)


def test_disguises_are_mapped_back():
    cases = {
        "write to john (at) example (dot) com now": ("email", "john (at) example (dot) com"),
        "mail jane.doe at mail dot example dot org please": ("email", "jane.doe at mail dot example dot org"),
        "jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),
        "ｊｏｅ＠ｘ．ｃｏｍ": ("email", "ｊｏｅ＠ｘ．ｃｏｍ"),
        "call plus one two one two five five five zero one nine nine": ("phone", "plus one two one two five five five zero one nine nine"),
        "ip one nine two dot one six eight dot one dot one": ("ip", "one nine two dot one six eight dot one dot one"),
        "card ４１１１111111111111": ("card", "４１１１111111111111"),
    }
    for text, (kind, part) in cases.items():
        assert (kind, part) in [(k, text[a:b]) for a, k, b in pii.all_spans(text)[1]], text
        assert f"<{kind.upper()}>" in pii.redacted(text) and part not in pii.redacted(text)
    for text in ("meet us at example.com today", "look at the dot and the line", "one two buckle my shoe", "seven (at) night"):
        assert pii.all_spans(text) == ([], [])


def test_mixed_digits_any_label_and_long_local_parts():
    long = " dot ".join(["abcdefghij"] * 20)
    cases = {
        "call +1 five five five 867 five three zero nine now": ("phone", "+1 five five five 867 five three zero nine"),
        "call plus one 212 five five five 0199": ("phone", "plus one 212 five five five 0199"),
        "ip one nine two dot 168 dot 1 dot one 443": ("ip", "one nine two dot 168 dot 1 dot one"),
        "ip one nine two dot one six eight dot one dot one 443": ("ip", "one nine two dot one six eight dot one dot one"),
        "card four 111 1111 one one one one 1111 ok": ("card", "four 111 1111 one one one one 1111"),
        "jane at acme dot tech": ("email", "jane at acme dot tech"),
        "jane at acme dot cloud, or": ("email", "jane at acme dot cloud"),
        "jane at acme dot online": ("email", "jane at acme dot online"),
        "jane at acme [dot] xyz": ("email", "jane at acme [dot] xyz"),
        f"to {long} at acme dot com": ("email", f"{long} at acme dot com"),
    }
    for text, (kind, part) in cases.items():
        assert [(k, text[a:b]) for a, k, b in pii.all_spans(text)[1]] == [(kind, part)], text
        assert f"<{kind.upper()}>" in pii.redacted(text) and part not in pii.redacted(text)
    for text in ("look at the dot and the line", "look at vector dot product", "we met at noon dot then left", "one 2 three 4 and 5 six", "plus one 2 three", "3 dot 5 dot 7"):
        assert pii.all_spans(text) == ([], []), text


def test_references_odd_signs_marks_and_repeated_digits():
    cases = {
        "to jane&#64;acme.com now": ("email", "jane&#64;acme.com"),
        "to jane&#x40;acme&period;com now": ("email", "jane&#x40;acme&period;com"),
        "to jane&commat;acme.com now": ("email", "jane&commat;acme.com"),
        "to jane%40acme.com now": ("email", "jane%40acme.com"),
        "to jane @ acme . com now": ("email", "jane @ acme . com"),
        "to jane @ mail . acme . org now": ("email", "jane @ mail . acme . org"),
        "to jane\uff20acme\u3002com now": ("email", "jane\uff20acme\u3002com"),
        "to jane@acme\u00b7com now": ("email", "jane@acme\u00b7com"),
        "to j\u0251ne@x.com now": ("email", "j\u0251ne@x.com"),
        "to jos\u00e9@x.com now": ("email", "jos\u00e9@x.com"),
        "to \u0458an\u0435@\u0445.com now": ("email", "\u0458an\u0435@\u0445.com"),
        "call plus one 212 double five five 0199 now": ("phone", "plus one 212 double five five 0199"),
        "call +1 212 triple 5 zero one nine nine now": ("phone", "+1 212 triple 5 zero one nine nine"),
    }
    for text, (kind, part) in cases.items():
        assert (kind, part) in [(k, text[a:b]) for a, k, b in pii.all_spans(text)[1]], text
        assert f"<{kind.upper()}>" in pii.redacted(text) and part not in pii.redacted(text)
    for text in ("lunch @ noon . bring food", "see you @ home . Thanks", "R&D &amp; &#64; 100%", "a double five and a triple", "caf\u00e9 cr\u00e8me \u00b7 th\u00e9", "look at page\u00b7two", "look at acme . com"):
        assert pii.all_spans(text) == ([], []), text
    plain, spans = pii.all_spans("to jane@acme.com\u3002Thanks")
    assert plain == spans and len(plain) == 1


def test_pii_over_tables(spark):
    df = make_docs(spark, [*EDGES, "a@b.com +1 (222) 555-2020, 1.2.3.4"], spans=F.lit(1), plain=F.lit(2))
    rows = sorted(pii.find(df).collect(), key=lambda r: r.doc_id)
    assert [len(r.spans) for r in rows] == [0] * len(EDGES) + [3]
    assert [s.kind for s in rows[-1].spans] == ["email", "phone", "ip"]
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] is None and clean[1] == "" and clean[len(EDGES)] == "<EMAIL> <PHONE>, <IP>"
    assert pii.find(df.limit(0)).count() == 0


def test_url_rules(spark):
    rules = [urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"), urls.Rule("com", "/", "allow"), urls.Rule("bare.org", "", "block")]
    cases = {
        "http://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://WWW.Example.com/en/?x": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.example.com/EN/": ("a.example.com", "/EN/", "com/", "allow"),
        "http://notexample.com": ("notexample.com", "", None, "allow"),
        "http://bare.org": ("bare.org", "", "bare.org", "block"),
        "http://bare.orgx/": ("bare.orgx", "/", None, "allow"),
        "http://a.net/casino-x": ("a.net", "/casino-x", None, "block"),
        "http://a.net/casinox": ("a.net", "/casinox", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*cases, *cases])], "page_id long, url string, host string")
    rows = sorted(urls.filter_urls(df, rules, [urls.word_rule("casino")]).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [*cases.values(), *cases.values()]
    assert urls.filter_urls(df.limit(0), rules).count() == 0
    assert urls.filter_urls(df, []).where("verdict = 'allow'").count() == len(rows)


def repeated(words, size=8):
    seen = {}
    for i in range(len(words) - size + 1):
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(size)})


def test_quality_counts_equal_brute_force(spark, docs):
    df = docs.unionByName(make_docs(spark, [*EDGES, "# * x\n\nx\nx\n" + "a b c d e f g h i " * 3]).withColumn("doc_id", F.col("doc_id") + 1_000_000)).withColumn("kept", F.lit(5)).withColumn("sketch", F.lit(""))
    rows = {r.doc_id: r for r in lines.judge(df).collect()}
    texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    assert rows.keys() == texts.keys()
    for key, text in texts.items():
        words, own = re.findall("[^\x20\x09-\x0d]+", text), rows[key]
        held = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(held) - len(set(held)), repeated(words))
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == expected
        assert own.base_failed == (len(words) < 20 or 100 * expected[4] > 30 * len(words))
    assert lines.judge(df.limit(0)).count() == 0


def test_boilerplate_lines_go_and_copies_stay(spark):
    rng = np.random.default_rng(5)
    own = [" ".join("".join(w) for w in rng.choice(list("abcdefghijklmnop"), (150, 9))) for _ in range(60)]
    menu = "Home About Contact 2024 Sign in Register Subscribe to the newsletter " * 4
    texts = [f"{x}\n{menu}" for x in own] + [menu + f"\nnew {i}" for i in range(60)] + ["\n".join([own[0], own[1]])] * 60
    df = make_docs(spark, texts)
    judged = lines.judge(df)
    rows = {r.doc_id: r for r in judged.collect()}
    assert all(rows[i].kept and len(rows[i].removed_lines) == 1 for i in range(60))
    assert not any(rows[i].kept for i in range(60, 120) if not rows[i].base_failed)
    assert all(rows[i].kept and not rows[i].removed_lines for i in range(120, 180))
    left = lines.without_lines(df.join(judged.select("doc_id", "removed_lines"), "doc_id"))
    assert left.where("doc_id = 0").first().text == own[0]


def test_depleted_pages_of_one_menu_count_each(spark):
    rng = np.random.default_rng(6)

    def words(n):
        return " ".join("".join(w) for w in rng.choice(list("abcdefghijklmnop"), (n, 9)))

    menu, copy = words(90), words(60)
    df = make_docs(spark, [f"{menu}\n{words(12)}" for _ in range(100)] + [words(100) for _ in range(200)] + [copy] * 100)
    rows = {r.doc_id: r for r in lines.judge(df).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert all(not rows[i].kept and rows[i].removed_words == 90 for i in range(100))
    assert all(rows[i].kept and not rows[i].removed_lines for i in range(100, 400))


def test_a_larger_host_excuses_no_line(spark):
    rng = np.random.default_rng(8)

    def words(n):
        return " ".join("".join(w) for w in rng.choice(list("abcdefghijklmnop"), (n, 9)))

    notice, rare = words(30), words(30)
    texts = [f"{words(5)}\n{notice}" for _ in range(21)] + [f"{words(5)}\n{rare}" for _ in range(20)] + [words(25) for _ in range(1000)]
    for size in (41, 500, 1041):
        rows = {r.doc_id: r for r in lines.judge(make_docs(spark, texts[:size])).collect()}
        assert sorted(i for i, r in rows.items() if not r.kept) == list(range(21))
        assert all(rows[i].removed_words == (30 if i < 21 else 0) for i in rows)


def test_template_places_count_once(spark):
    """Diagonals 0, 2, 5 and 8 are one span of four matches, but the first and the last are of the same place: three of the eight, under the limit."""
    texts = ["a b c d c d e f a b c d h i j k", "a b c d e f g h i j k", "a b c d e f g h i j"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = license.spans(df, base=(), more=(), passages=(("a b c d e f g h i j k", "x"),)).collect()
    assert {r.doc_id: round(r.score, 6) for r in found} == {1: 1.0, 2: round(10 / 11, 6)}


def test_license_spans(spark):
    passage = license.PASSAGES[0][0]
    changed = passage.replace("free of charge", "free of any charge").replace("merge ", "")
    texts = [None, "", "Released under the MIT License.", "mit\nlicense, the Apache-License! GENERAL public license mit license", f"x {changed.upper()} y", "permission is hereby granted", "mitlicense mit", "MİT license", "all rights reserved"]
    df = make_docs(spark, texts, labels=F.lit(1), w=F.lit(2), pos=F.lit(3))
    rows = {r.doc_id: r for r in license.scan(df).collect()}
    assert [rows[i].n_base for i in range(len(texts))] == [0, 0, 1, 4, 0, 0, 0, 0, 0]
    assert (rows[3].first_word, rows[3].last_word, rows[3].base_labels) == (0, 8, "apache,gpl,mit")
    assert rows[2].first_word == 3 and rows[0].first_word is None
    assert rows[4].labels == "mit" and rows[4].base_labels == "" and 0.6 <= rows[4].score < 1
    assert rows[5].labels == "" and rows[8].labels == "all-rights-reserved"
    span = license.spans(df).where("doc_id = 4").first()
    assert (span.start, span.end) == (1, 1 + len(changed.split()))
    twice = license.scan(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(texts) and all(r.n_base == rows[r.doc_id].n_base for r in twice)
    assert license.scan(df.limit(0)).count() == 0


def test_ordinal_held_out(spark):
    rng = np.random.default_rng(7)

    def text(grade):
        words = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(30, 200))]
        if grade == 0:
            words = [f"{w}***" for w in words]
        if grade == 1:
            words[5], words[17] = "awful", "nasty"
        return " ".join(words)

    grades = rng.integers(0, 3, 900).tolist()
    df = make_docs(spark, [text(g) for g in grades])
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i < 600] + [(1, None), (None, 1), (10_000, 2), (3, 99)], "doc_id long, grade int")
    model = ordinal.fit(df, labels, 3)
    assert (np.diff(model.thresholds) > 0).all()
    rows = ordinal.rate(df, model).where("doc_id >= 600").collect()
    assert np.mean([r.selected == (grades[r.doc_id] == 2) for r in rows]) > 0.9
    assert np.mean([abs(r.expected_grade - grades[r.doc_id]) < 0.7 for r in rows]) > 0.85
    again = ordinal.fit(df.repartition(7), labels.repartition(3), 3)
    assert np.allclose(again.words, model.words) and np.allclose(again.thresholds, model.thresholds)


def test_ordinal_edge_cases(spark):
    df = make_docs(spark, EDGES, tail=F.lit("x"))
    empty = ordinal.fit(df, spark.createDataFrame([], "doc_id long, grade int"), 3)
    rows = {r.doc_id: r for r in ordinal.rate(df, empty).collect()}
    assert len(rows) == len(EDGES) and not any(rows[i].selected for i in range(3))
    one = ordinal.fit(df, spark.createDataFrame([(3, 2), (3, 1), (0, 0)], "doc_id long, grade int"), 3)
    assert ordinal.rate(df.limit(0), one).count() == 0


def test_digest_is_of_the_written_spans(spark, sf):
    from termweave.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_pii"](spark, sf).collect():
        written = ",".join(f"{k}:{a}:{b}" for a, k, b in plain(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()


def test_quality_verdicts_equal_brute_force(spark):
    """Hosts with shared menus, copies, edited copies and short texts, judged by plain counting."""
    rng = np.random.default_rng(11)

    def words(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))

    menus = [words(int(n)) for n in (12, 9, 30)]
    rows = []
    for i in range(400):
        own = [words(int(rng.integers(2, 14))) for _ in range(int(rng.integers(0, 6)))]
        shown = [menus[m].upper() if rng.random() < 0.3 else f"  {menus[m]} " for m in range(3) if rng.random() < (0.06, 0.4, 0.7)[m]]
        lines_of = [*own, *shown]
        rng.shuffle(lines_of)
        rows.append((i, "\n".join(lines_of), ["a", "b", None][int(rng.integers(0, 3)) if i % 3 else 0]))
    rows += [(1_000 + i, rows[5][1], rows[5][2]) for i in range(60)]  # copies make none of their lines boilerplate
    rows += [(2_000 + i, f"{words(3)}\n{menus[0]} {i}", "c") for i in range(25)]  # numbers don't tell lines apart
    rows += [(3_000, None, "a"), (3_001, "", None), (3_002, "x " * 40, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def normal(line):
        return re.sub("[0-9]+", "0", " ".join(re.findall("[^\x20\x09-\x0d]+", line)).lower())

    held = {}
    for text, host in {(t, h) for _, t, h in rows}:
        for line in {normal(x) for x in (text or "").split("\n")} - {""}:
            held[host, line] = held.get((host, line), 0) + 1
    expected = {}
    for key, text, host in rows:
        every = (text or "").split()
        gone = sum(len(x.split()) for x in (text or "").split("\n") if held.get((host, normal(x)), 0) > lines.LINE_DOCUMENTS)
        failed = len(every) < 20 or 100 * repeated(every) > 30 * len(every)
        expected[key] = (failed, gone, not failed and len(every) - gone >= lines.LEAST_LEFT * len(every))
    assert {r.doc_id: (r.base_failed, r.removed_words, r.kept) for r in lines.judge(df).collect()} == expected
    kept = [x[2] for x in expected.values()]
    assert 20 < sum(kept) < len(kept) - 20 and any(not f and not k for f, _, k in expected.values())


def plain_score(model, text):
    """The score by single features: distinct words with their edges cut, and shares of word shapes."""
    every = text.split()
    found = {xxhash.xxh64_intdigest(w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").encode()) % ordinal.WORDS for w in every}
    score = sum(float(model.words[i]) for i in found)
    for w in every:
        shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "0", w)))
        score += ordinal.SHAPE_SCALE * float(model.shapes[xxhash.xxh64_intdigest(shape.encode(), 1) % ordinal.SHAPES]) / len(every)
    if len(every) >= 20:
        score += ordinal.SHAPE_SCALE * float(model.shapes[ordinal.SHAPES]) * max(0.0, 1 - 3 * len(found) / len(every))
    return score


def test_ordinal_fit_and_tails_equal_a_plain_computation(spark):
    """The fit reaches the penalised likelihood that plain descent along numeric slopes reaches; grades and tails follow from single features."""
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 90).tolist()
    texts = [" ".join(f"{'abcdef'[x]}" for x in rng.choice(6, 3, replace=False, p=np.roll([0.4, 0.25, 0.15, 0.1, 0.05, 0.05], 2 * g))) for g in grades]
    penalty = 2e-3
    features = ordinal.Features()
    rows = [(*features.of(t), g) for t, g in zip(texts, grades, strict=True)]
    model = ordinal.fit_rows(rows, 3, penalty=penalty, steps=3_000)

    used = sorted({int(i) for r in rows for i in r[0]})
    shape = [i for i in range(ordinal.SHAPES + 1) if any(r[1][i] for r in rows)]
    x = np.array([[float(i in set(r[0].tolist())) for i in used] for r in rows])
    y = np.array([[float(r[1][i]) for i in shape] for r in rows])
    weight = np.array([len(grades) / (3 * grades.count(g)) for g in grades])
    at = np.arange(len(grades))

    def tails(v):
        z = x @ v[: len(used)] + y @ v[len(used) : -2]
        return np.stack([1 / (1 + np.exp(v[-2] - z)), 1 / (1 + np.exp(v[-2] + np.exp(v[-1]) - z))], axis=1)

    def smooth(v):
        edges = np.hstack([np.ones((len(at), 1)), tails(v), np.zeros((len(at), 1))])
        return float(-(weight * np.log(edges[at, grades] - edges[at, np.array(grades) + 1])).sum() / len(at) + 5e-6 * (v[len(used) : -2] ** 2).sum())

    def whole(v):
        return smooth(v) + penalty * np.abs(v[: len(used)]).sum()

    v = np.zeros(len(used) + len(shape) + 2)
    v[-2] = -1.0
    steps = np.eye(len(v)) * 1e-5
    for _ in range(6_000):
        slope = np.array([(smooth(v + d) - smooth(v - d)) / 2e-5 for d in steps])
        slope[len(used) : -2] /= ordinal.SHAPE_SCALE**2
        v = v - 0.5 * slope
        v[: len(used)] = np.sign(v[: len(used)]) * np.maximum(np.abs(v[: len(used)]) - 0.5 * penalty, 0)
    own = np.concatenate([model.words[used], model.shapes[shape], [model.thresholds[0], np.log(np.diff(model.thresholds)[0])]]).astype(float)
    assert abs(whole(own) - whole(v)) < 2e-3
    assert np.abs(tails(own) - tails(v)).max() < 0.03

    more = ["Hello, World 42 (a) b!", "a b c " * 12, "zz -- a\tA", "", None]
    df = spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string")
    for r in ordinal.rate(df, model).collect():
        z = plain_score(model, r.text or "")
        tail = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert abs(r.expected_grade - sum(tail)) < 1e-5
        assert abs(r.tail - (tail[-1] if (r.text or "").strip() else 0)) < 1e-5 and r.selected == (r.tail >= 0.5)
