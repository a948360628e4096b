"""License notices, secrets and URL verdicts."""

import random
import re
import string

from pyspark.sql import functions as F

from notelake.llm import licenses, secrets, urls


def test_longest_rising_run():
    rng = random.Random(1)
    for _ in range(200):
        second = rng.sample(range(30), rng.randrange(1, 12))
        pairs = list(enumerate(second))
        best = [1] * len(pairs)
        for i in range(len(pairs)):
            best[i] = 1 + max([best[j] for j in range(i) if second[j] < second[i]], default=0)
        got = licenses._rising(pairs)
        assert len(got) == max(best) and got == sorted(got) and all(a[1] < b[1] for a, b in zip(got, got[1:]))
    assert licenses._rising([]) == []


def test_patience_pairs_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(25))] for _ in range(2))
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert licenses.patience(a, a) == [(i, i) for i in range(len(a))]
    assert licenses.patience("a x b c d".split(), "a b y c d".split()) == [(0, 0), (2, 1), (3, 3), (4, 4)]


def test_notices(spark, make_notes):
    apache, mit = dict(t[::1] for t in licenses.TEMPLATES[1::2])["Apache-2.0"], licenses.TEMPLATES[3][1]
    rng = random.Random(3)
    filler = " ".join(rng.choice(("alpha", "beta", "of", "the", "and")) for _ in range(500))
    edited = mit.replace("hereby granted", "granted").replace("Software", "Program", 1).upper()
    rows = [
        ("v", "line", "İ\nLicensed under the Apache License, Version 2.0.\n" + filler), ("v", "full", filler + "\n" + apache.replace(" ", "\n  * ") + "\n" + filler),
        ("v", "edited", filler + edited), ("v", "twice", "Released under the MIT License. Released under the MIT License."),
        ("v", "clean", filler + " license version the of"), ("v", "none", None), ("v", "empty", ""), (None, None, "Licensed under CC BY-NC 4.0."),
        ("v", "long", filler * 400 + " Released under the MIT License."), ("v", "line", "Released under the MIT License."),
    ]
    got = licenses.find_licenses(make_notes(rows).withColumn("license", F.lit(1))).collect()
    text = {p: t for _, p, t in rows[::-1]}
    assert sorted((r.path, r.license) for r in got) == sorted(
        [("line", "Apache-2.0"), ("full", "Apache-2.0"), ("edited", "MIT"), ("twice", "MIT"), ("twice", "MIT"), ("", "CC-BY-NC-4.0"), ("long", "MIT"), ("line", "MIT")]
    )
    full = next(r for r in got if r.path == "full")
    assert full.coverage == 1.0 and text["full"][full.start :].startswith("Licensed") and text["full"][: full.end].endswith("License")
    line = next(r for r in got if r.path == "line" and r.license == "Apache-2.0")
    assert text["line"][line.start : line.end] == "Licensed under the Apache License, Version 2.0"
    assert licenses.find_licenses(make_notes(rows).limit(0)).collect() == []


def test_notices_get_the_right_name(spark, make_notes):
    full = {}
    for name, text in licenses.ALL_TEMPLATES:
        full[name] = max(full.get(name, ""), text, key=len)
    want = {
        "Released under the BSD License.": ["BSD"], "Released under the BSD 2-Clause License.": ["BSD-2-Clause"], "Licensed under CC BY 4.0.": ["CC-BY-4.0"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"], "Released under CC-BY-SA-3.0": ["CC-BY-SA-3.0"],
        "Licensed under the Apache License, Version 1.1.": ["Apache-1.1"], "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "Licensed under the Apache License 2.0": ["Apache-2.0"], "Released under the MIT License.": ["MIT"], "Released under the MIT Licence.": ["MIT"], "Released under the MIT.": ["MIT"],
        "Released under the MIT Press agreement": [], "Released under the modified MIT License.": [], "Released under the ISC License.": ["ISC"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"], "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "This work is licensed under the GNU General Public License v3": ["GPL-3.0"], "This work is licensed under the GNU General Public License.": ["GPL"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"], "It is licensed under the LGPL version 2.1": ["LGPL-2.1"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"], "Licensed under the Mozilla Public License, version 2.0.": ["MPL-2.0"],
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["CC-BY-4.0"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
        "Released under the MIT License. Licensed under CC BY 4.0.": ["MIT", "CC-BY-4.0"], "Mit der Lizenz the license is under the released": [],
    }
    for name in ("Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "HPND", "MPL-2.0"):
        want[f"Some notes.\n{full[name]}\nMore notes."] = [name]
    later = full["GPL-2.0"]
    only = later[: later.index("the GNU")] + "version 2 of the GNU General Public License as published by the Free Software Foundation" + later[later.index(". This program is") :]
    want |= {only: ["GPL-2.0"], later.replace("GNU General", "GNU Library General"): ["LGPL-2.0"], later.replace("version 2", "version 9"): ["GPL"]}
    got = {}
    for r in licenses.find_licenses(make_notes([("v", text, text) for text in want])).collect():
        got.setdefault(r.path, []).append((r.start, r.license))
    assert {text: [name for _, name in sorted(got.get(text, []))] for text in want} == want


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, secrets.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    words = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "AKIA", "=", ":", '"', "'", " ", "abc", "a1b2c3d4", "ABCDEF12", "\n", "é", "K", "ſ"]
    for _ in range(3000):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(30)))
        assert secrets.base_spans(text) == brute_secrets(text), text


def test_secrets(spark, make_notes):
    rng = random.Random(5)
    random_ = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    rows = [
        ("v", "novel", "We met to talk about the move of the servers. " * 5 + f"the access key of staging is {random_} for now"), ("v", "name", "the access key handler is access_token_response_handler_v2_default"),
        ("v", "plain", f"some id {random_} without context"), ("v", "base", "password = 'hunter2hunter2'"), ("v", "null", None), ("v", "empty", ""),
        (None, None, "AKIA" + "A1" * 8), ("v", "base", "password = 'hunter2hunter2'"), ("v", "long", "é" * 200_000 + " secret: abcdef " + "0123456789abcdef" * 2),
    ]
    got = {}
    for r in secrets.find_secrets(make_notes(rows).withColumn("spans", F.lit(1))).collect():
        got.setdefault(r.path, []).append([(s.kind, s.start, s.end) for s in r.spans])
    start = rows[0][2].index(random_)
    assert got["novel"] == [[("novel", start, start + 40)]]
    assert got["name"] == got["plain"] == got["null"] == got["empty"] == [[]]
    assert got["base"] == 2 * [[("assign", 0, 27 - 1)]] and got[""] == [[("access", 0, 20)]]
    assert [k for k, *_ in got["long"][0]] == ["assign", "hex"] and got["long"][0][0][1] == 200_001
    assert secrets.find_secrets(make_notes(rows).limit(0)).collect() == []


def test_novelty_tells_random_from_words():
    novelty, rng = secrets.Novelty(), random.Random(6)
    around = "Notes of the meeting about staging, which went on for longer than we had hoped it would. " * 3 + "The key is "
    names = random_ = 0
    for _ in range(200):
        token = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(20, 60)))
        random_ += novelty.of(token, around, " here") >= secrets.NOVELTY
        name = "_".join(rng.choice(secrets.IDENTIFIERS.split()) for _ in range(4)) + "1"
        names += novelty.of(name, around, " here") >= secrets.NOVELTY
    assert random_ >= 195 and names <= 5


def test_novel_strings_are_whole():
    novelty, rng = secrets.Novelty(), random.Random(8)
    token = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))

    def spans(text):
        return [(a, b) for a, b, _ in secrets.novel_spans(text, secrets.base_spans(text), novelty)]

    filler = ("so we went on to talk of the other things and " * 200)[:380]
    for size, gap in ((60, 380), (60, 340), (60, 395), (600, 1), (5000, 1), (60, 9000)):
        piece, between = token(size), (filler * 30)[: gap - 1] + " "
        for head, tail in (("the private key is " + between, ""), ("", between + " as bearer")):
            text = f"First line.\n{head}{piece} {tail}\nlast line {token(40)}"
            at = text.index(piece)
            assert spans(text) == [(at, at + size)], (size, gap)
    lines = [token(64) for _ in range(20)]
    for kind in ("PRIVATE KEY", "RSA PRIVATE KEY", "PGP PRIVATE KEY BLOCK"):
        for end in (f"-----END {kind}-----\n{token(50)}\n", ""):
            text = f"{token(50)}\n-----BEGIN {kind}-----\n\n" + "\n".join(lines) + "\n" + end
            assert spans(text) == [(text.index(x), text.index(x) + 64) for x in lines]
    cut = "-----BEGIN CERTIFICATE-----\n" + "\n".join(lines)
    assert spans(cut) == [] and spans(cut + "\n-----END CERTIFICATE-----\nno secret here") == []


ALPHABETS = {
    "upper hex": "0123456789ABCDEF", "lower hex": "0123456789abcdef", "base32": string.ascii_uppercase + "234567",
    "lower": string.ascii_lowercase + string.digits, "base64": string.ascii_letters + string.digits + "+/",
}


def test_recall_by_alphabet_and_length():
    novelty, rng = secrets.Novelty(), random.Random(9)
    words = lambda n: " ".join(rng.choice(secrets.IDENTIFIERS.split()) for _ in range(n))
    for name, letters in ALPHABETS.items():
        for size in (16, 20, 24, 32, 40, 64, 128):
            found = 0
            for _ in range(60):
                piece = "".join(rng.choice(letters) for _ in range(size - 2)) + ("a7" if name.startswith("lower") else "A7")
                before = words(50) + "\nthe private key is "
                text = before + piece + " for now\n" + words(50)
                known = secrets.base_spans(text)
                at = (len(before), len(before) + size)
                found += at in [(a, b) for a, b, _ in known] + [(a, b) for a, b, _ in secrets.novel_spans(text, known, novelty)]
            assert found >= 0.9 * 60, (name, size, found)
    names = 0
    for _ in range(200):
        text = words(40) + "\nthe token is " + "_".join(words(4).split()) + str(rng.randrange(100)) + " today\n" + words(40)
        names += bool(secrets.novel_spans(text, secrets.base_spans(text), novelty))
    assert names <= 4


def test_values_below_a_key_and_values_with_signs():
    novelty = secrets.Novelty()

    def found(text):
        return [text[a:b] for a, b, _ in secrets.novel_spans(text, secrets.base_spans(text), novelty)]

    one, two, other = "Zk39qPx81LmQv02TsYwB", "a9Kd83mXq02LsPzRt7Wv", "Hu7bWq55pXe0Jn4vRc8D"
    assert found(f"secret:\n  value: {one}\nother: {other}\n") == [one]
    assert found(f"  api key:\n\n    {one}\n    {two}\n  next {other}") == [one, two]
    assert found(f"token =\n{one}\n{other}\n") == [one]
    assert found(f"a token is meant\n  {one}\n") == [] and found(f"secret:\n\n\n{one}") == [one] and found("secret:") == []
    assert found(f"a:\n  secret: |\n    {one}\n   x\n  {other}") == [one]
    assert found("password = 'x9!Kq$2mZp@4Lt'") == ["x9!Kq$2mZp@4Lt"]
    assert found("the password: x9!Kq$2mZp@4Lt.") == ["x9!Kq$2mZp@4Lt"]
    assert found("password: $DB_PASSWORD_V2_MAIN") == found("password: !!!!!!!!!!!!!!!!!!") == found("token: https://a.b/c?d=e1") == []


def test_many_nested_keys_take_linear_time():
    text = "".join(" " * (k % 300) + "secret:\n" for k in range(30_000))
    assert secrets.contexts(text)[0][0] == 0


RULES = urls.RULES


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for what, rule in RULES:
        name, tail = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best and best[1], best and best[0]


URLS = [
    None, "", "no scheme", "http://", "http://A.NET", "http://a.NET/", "http://a.net/x?y=1", "https://example.net/en/1", "https://x.example.net/en", "https://badexample.net/en/2",
    "http://example.com/de/1#f", "http://m.example.com/de/", "http://example.com/fr/", "http://a.org/fr/x", "http://org/fr/", "http://a.org?x=/fr/", "ftp://b.org/en/://c.net/",
    "http://é.org/fr/ü", "//x.net/", "http://net/", "http://x.net:80/", "http://" + "a" * 5000 + ".net/" + "p/" * 3000,
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(99, URLS[5]), (99, URLS[5])], "page_id bigint, url string")
    df = df.withColumns({"host": F.lit(1), "rule": F.lit(2), "label": F.lit(3)})
    model = urls.learn_urls(spark.createDataFrame([], "url string, verdict string"))
    got = urls.judge_urls(df, model).select("row.page_id", "host", "path", "rule", "verdict").collect()
    want = [(i, *brute_url(u)) for i, u in enumerate(URLS)] + 2 * [(99, *brute_url(URLS[5]))]
    key = lambda r: (r[0], r[1])
    assert sorted(((*w[:4], w[4] or "allow") for w in want), key=key) == sorted(map(tuple, got), key=key)
    assert urls.judge_urls(df.limit(0), model).collect() == []


def test_trees_learn_lexical_features(spark):
    rng = random.Random(7)

    def url(bad):
        word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
        host = f"{word(4)}-{word(4)}-{word(3)}.example.com" if bad else f"{word(8)}.example.com"
        tail = "&".join(f"p{rng.randrange(100)}={rng.randrange(10**6)}" for _ in range(4)) if bad else "id=1"
        return f"http://{host}/{word(3)}/{rng.randrange(1000)}?{tail}", "block" if bad else "allow"

    rows = [url(k % 3 == 0) for k in range(600)]
    df = spark.createDataFrame(rows, "url string, verdict string")
    model = urls.learn_urls(df.limit(400))
    test = spark.createDataFrame([url(k % 2 == 0) for k in range(200)], "url string, verdict string")
    got = urls.judge_urls(test, model, rules=()).select("row.verdict", F.col("verdict").alias("said")).collect()
    assert sum(r.verdict == r.said for r in got) >= 195
    judged = urls.judge_urls(spark.createDataFrame([(None,), ("",)], "url string"), model, rules=()).collect()
    assert len(judged) == 2 and all(r.verdict in ("allow", "block") for r in judged)


def test_verdicts_differ_inside_a_suffix(spark):
    """Unseen hosts of the same suffixes as the labelled table, good and bad ones alike."""
    model = urls.learn_urls(urls.example_urls(spark))
    good = ["www.ththen", "therha", "blog.sunrise", "m.farmer", "history", "tionble"]
    bad = ["spam-farm", "www.cheap-pills", "m.adult-x", "blog.big-casino", "free-money", "hot-deals"]
    rows = [(f"https://{h}.example.{s}/en/{k}.html", v) for s in ("com", "org", "net") for v, hosts in (("allow", good), ("block", bad)) for k, h in enumerate(hosts, 140)]
    got = urls.judge_urls(spark.createDataFrame(rows, "url string, verdict string"), model, rules=()).select("row.url", "row.verdict", F.col("verdict").alias("said")).collect()
    for suffix in ("com", "org", "net"):
        mine = [r for r in got if f".{suffix}/" in r.url]
        assert {r.said for r in mine} == {"allow", "block"} and sum(r.verdict == r.said for r in mine) >= 11, mine


def test_learned_urls_are_bounded_and_different(spark):
    """Copies count once and the draw is the same whatever the order; rates are smoothed."""
    rows = [(f"http://h{k % 97}.example.{'com' if k % 2 else 'org'}/{k}", "block" if k % 2 else "allow") for k in range(400)]
    df = spark.createDataFrame(rows + rows[:50] * 4 + [(None, "block"), ("http://x", None), ("http://y", "other")], "url string, verdict string")
    model = urls.learn_urls(df, sample=100)
    drawn = model.suffixes.collect()
    assert abs(sum(r.suffix_share for r in drawn) - 1) < 1e-9 and all(0 < r.suffix_blocked < 1 for r in drawn)
    again = urls.learn_urls(df.orderBy(F.desc("url")), sample=100)
    assert sorted(map(tuple, again.suffixes.collect())) == sorted(map(tuple, drawn))
    assert urls.learn_urls(df.where("verdict = 'block'")).constant == "block" and urls.learn_urls(df.limit(0)).constant == "allow"
