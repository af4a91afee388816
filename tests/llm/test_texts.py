"""Residue, boilerplate, repeated lines, languages and encodings."""

import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.llm import boilerplate, language, mojibake, repeated_lines, residue
from webloom.llm import queries as q

SCHEMA = "id BIGINT, title STRING, content STRING, line_no STRING, evidence STRING"


@pytest.fixture(scope="module")
def samples(spark, sf):
    return spark.read.parquet(f"{sf}/lang_samples.parquet")


def rows(spark, *contents):
    return spark.createDataFrame([(i, None, c, "x", "y") for i, c in enumerate(contents)], SCHEMA)


RESIDUE = ["Dear {{ user.name }}, welcome to the shop of this town.", "[[teaser]]", "%%city%%", "404 Page not found", "Real text.\nPlease enable JavaScript to view this page.\nMore text.", "Ex minim aliqua labore quis velit. Dolor sit amet magna.", "text text text text text", "NaN", "The council moved [Your text here] to May.", "Traceback: template rendering failed at line 3"]
CLEAN = ["The course explains how {{ name }} is written in a letter template and later filled in.", "The exhibition is called Error 404 and shows lost maps.", "Printers have long used lorem ipsum as dummy text, the curator explained.", "The app works without JavaScript.", "404 questions about the flood barrier", "```\n${x}\n```", "", None, "a [quoted] word", "x" * 200_000]


def test_residue(spark):
    df = rows(spark, *RESIDUE, *CLEAN)
    assert {r.id for r in residue.detect(df).collect()} == set(range(len(RESIDUE)))
    assert residue.without_residue(df).count() == len(CLEAN)
    assert residue.detect(df.limit(0)).count() == 0
    assert [k for k, _ in residue.find_residue("Sample page", True)] == ["title"]


def test_residue_screen_is_a_superset():
    lines = ["Warning: Division by zero in /srv/a.php on line 12", "Exception (code 7)", "Fatal error: " + "x" * 300, "text " * 60, "text, text, text, text", "   NaN" + " " * 30, "Ut enim ad quis nisi ut."]
    for line in lines:
        assert residue.residue_line(line) and residue.find_residue(line) and residue.may_hold(line), line
    assert residue.find_residue("[insert " + "a long hint " * 20 + "]") and residue.find_residue("<% " + "call " * 40 + "%>")


#: Ordinary notices whose wording stands nowhere in the package.
NOTICES = """404 Not Found|403 Forbidden|502 Proxy Error|Error 503: Service Unavailable|Access denied|Access to this page has been denied.|You do not have permission to view this page
The requested URL was not found on this server.|Your session has expired, please log in again|Something went wrong. Please try again.|The server encountered an internal error|Error establishing a database connection|Bad gateway
You need to enable JavaScript to run this app.|JavaScript is disabled in your browser.|This site requires Javascript to work, please enable it.|We're sorry but this app doesn't work properly without JavaScript enabled.|Please enable cookies in your browser
Checking your browser before accessing|Please verify you are a human|Bitte aktivieren Sie JavaScript in Ihrem Browser.|Ihr Browser wird überprüft|Die Seite konnte nicht gefunden werden|Der Server ist nicht erreichbar|403 Verboten
Veuillez activer JavaScript pour continuer.|La session a expiré|Ce contenu n'est pas disponible|Habilite JavaScript para continuar|Esta página no está disponible|Ta strona nie istnieje|Эта страница недоступна|Your text here|This is a sample article.""".replace("\n", "|").split("|")
PROSE = """Forbidden|Not found|The court found that access was denied to reporters.|The app works without JavaScript.|The page of history has been turned.|404 not found guilty by the jury|Police are checking your browser history, the lawyer said.
Scripts are a matter of taste, the actor said.|A site visit was refused by the mayor.|He was denied access to his lawyer.|The bus service failed again on Monday.|The file has been moved to the archive of letters.|Der Zugang zum Park wurde gesperrt.
The bridge was closed because of an error in the plan.|This article is here.|No evidence was found.|A sign saying page not found hung above the empty bookshelf as a joke.""".replace("\n", "|").split("|")


def test_notices_in_other_wording():
    for line in NOTICES:
        assert residue.find_residue("Real text of the town.\n" + line), line
    for line in PROSE:
        assert not residue.find_residue(line), line


def test_density_tells_tutorials_from_templates():
    about = "A template holds a placeholder such as {{ name }} between curly braces. "
    assert not residue.find_residue(about * 3 + "\nThen write {{ city }} as well.")
    assert residue.find_residue("The council met. " * 9 + about + "\nIt moved to {{ city }} in May.")
    assert residue.find_residue(about + "\n" + "{{ city }} {{ name }} {{ day }}")
    assert residue.find_residue("written by {!author_bio!} today") and residue.find_residue("x {!! $user->name !!} y")


NAV, FOOT = ["Home", "Sport", "Weather", "Contact"], ["Related stories", "The market hall was sold {n}", "- {n} questions about the line", "© 2025 Town Post. All rights reserved."]


def page(n: int, words: str = "abcdefghij") -> str:
    body = [f"The council of {words[n % 10]}{n} has moved the night bus line number {words[n // 10 % 10] * 3} after a long debate in the hall.", f"A new line {words[n % 10] * 4}{words[n // 10] * 3}", f"It was the {words[n % 7] * 5} time that the line had to be moved, said the office of the mayor of {words[n % 9] * 6}.", "{{teaser}}"]
    return "\n".join([*NAV, "News > Local > The council moved the line", "We use cookies to remember your settings, and so do our partners.", "", *body, f"{n} people have read this", *FOOT, "00:00 / 03:42"]).replace("{n}", words[n % 10] * (2 + n % 3))


def test_boilerplate(spark, samples):
    """Furniture is told from what a source repeats; copies of one article repeat nothing."""
    stops = boilerplate.stop_words(samples)
    assert {"the", "der", "la"} <= stops
    copy = "\n".join(f"This is sentence {x} of an article that is stored again and again by its site." for x in ("one", "two", "three"))
    texts = [(i, "town", page(i)) for i in range(60)] + [(100 + i, "town", copy) for i in range(8)] + [(200, "town", ""), (201, None, None), (202, "other", "One short line"), (203, None, page(7))]
    df = spark.createDataFrame(texts, "id BIGINT, site STRING, content STRING").withColumn("_flags", F.lit("clash"))
    found = defaultdict(set)
    for r in boilerplate.furniture_lines(df, stops, ["id"], source="site").collect():
        found[r.id].add(r.line_no)
    assert all(found[i] == {1, 2, 3, 4, 5, 6, 12, 13, 14, 15, 16, 17} for i in range(60))
    assert set(found) == set(range(60)) | {203} and {1, 2, 3, 4, 5, 17} <= found[203]
    bodies = {r.id: r.body for r in boilerplate.main_body(df, stops, ["id"], source="site").collect()}
    assert bodies[0].startswith("The council") and bodies[0].endswith("{{teaser}}")
    assert (bodies[200], bodies[201], bodies[202], bodies[100]) == ("", None, "One short line", copy)
    assert boilerplate.furniture_lines(df.limit(0), stops, ["id"], source="site").count() == 0
    assert boilerplate.furniture_lines(df, stops, ["id"]).count() > 0


def test_repeated_lines_match_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW scraped_items AS SELECT * FROM '{sf}/scraped_items.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT id, line_no FROM ({q.P4_SQL})").fetchall()}
    got = [tuple(r) for r in q.p4_found(spark, sf).select("id", "line_no").collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_repeated_blocks(spark):
    """Separators before a block, ties, nulls, equal rows and a null source."""
    texts = [f"own {'xyzuvw'[n]}\nA!\nb\ntail {'xyzuvw'[n]}" for n in range(6)] + ["A\nB", "a", None, "", "A\nB"]
    df = spark.createDataFrame([(i, 1 if i < 9 else None, t, "x") for i, t in enumerate(texts)], "id BIGINT, s BIGINT, t STRING, _line STRING")
    lines = repeated_lines.keyed(df, "s", "id", "t")
    blocks = repeated_lines.repeated_blocks(lines, repeated_lines.common_lines(lines, "s"), "s").collect()
    assert sorted((len(r.block), r.docs) for r in blocks) == [(1, 7), (1, 8), (2, 7)]
    found = {tuple(r) for r in repeated_lines.repeated_positions(df, "s", "id", "t").collect()}
    assert found == {(i, n) for i in range(6) for n in (2, 3)} | {(6, 1), (6, 2), (7, 1)}
    clean = {r.id: r.t for r in repeated_lines.without_repeated(df, "s", "id", "t").collect()}
    assert clean[0] == "own x\ntail x" and clean[6] == "" and clean[8] is None and clean[10] == "A\nB" and len(clean) == 11
    assert repeated_lines.repeated_positions(df.limit(0), "s", "id", "t").count() == 0


def test_blocks_of_lines_that_stand_twice(spark):
    """Against all blocks counted plainly: a line at the top and again at the bottom."""
    import itertools
    import random

    rng = random.Random(4)
    texts = ["\n".join([*"AB", "own " + "xyzuvw"[n], *"AC", *rng.choices("ABC", k=4), "end " + "pqrstu"[n], "A", "B"]) for n in range(6)] + ["A\nB\nA\nB"] * 2
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "id BIGINT, s BIGINT, t STRING")
    lines = repeated_lines.keyed(df, "s", "id", "t")
    common = repeated_lines.common_lines(lines, "s")
    names = set(itertools.chain(*(r._common for r in common.collect())))
    docs = defaultdict(set)
    for i, keys in lines.select("id", "_keys").collect():
        for a, b in itertools.combinations(range(len(keys) + 1), 2):
            if all(k in names for k in keys[a:b]):
                docs[tuple(keys[a:b])].add(i)
    longer = {x: [len(docs[y]) for y in docs if len(y) == len(x) + 1 and y[: len(x)] == x] for x in docs}
    want = {x: len(d) for x, d in docs.items() if len(d) >= 4 and max(longer[x], default=0) < len(d)}
    got = {tuple(r.block): r.docs for r in repeated_lines.repeated_blocks(lines, common, "s").collect()}
    assert {x: n for x, n in got.items() if x in want} == want and all(n == len(docs[x]) for x, n in got.items())


def test_language_held_out(spark, samples):
    model = language.train(samples.where("sample_id % 2 = 0"))
    test = samples.where("sample_id % 2 = 1").select(F.col("sample_id").alias("id"), F.col("text").alias("title"), F.col("text").alias("content"), "lang")
    got = language.label(test, model).join(test, "id").select("lang", "title_lang", "langs").collect()
    assert sum(r.lang == r.title_lang for r in got) >= 0.97 * len(got)
    assert sum(r.langs == [r.lang] for r in got) >= 0.97 * len(got)


def test_language_edges(spark, samples):
    model = language.train(samples)
    by = {r.lang: r.text for r in samples.collect()}
    some = lambda v: [r.text for r in samples.where(F.col("lang") == v).orderBy("sample_id").limit(6).collect()]
    mixed = "\n".join(some("en") + some("it"))
    df = rows(spark, None, "", "12 — 34", mixed, "Dolor sit amet consectetur adipiscing elit magna aliqua.", by["ru"])
    got = {r.id: r for r in language.label(df, model).collect()}
    assert [got[i].langs for i in (0, 1, 2, 4, 5)] == [[], [], [], [], ["ru"]]
    assert set(got[3].langs) == {"en", "it"} and {s.lang for s in got[3].segments} == {"en", "it"}
    assert got[0].title_lang == "und" and got[0].title_confidence == 0
    assert language.label(df.limit(0), model).count() == 0
    items = spark.createDataFrame([(1, None, mixed * 2, None), (2, None, by["de"] * 9, '{"lang": "DE-at"}'), (3, None, by["de"] * 9, '{"lang": "en"}'), (4, None, by["de"] * 9, '{"lang": "und"}'), (5, None, "kurz", None)], "id BIGINT, title STRING, content STRING, metadata_json STRING")
    assert sorted(tuple(r) for r in language.wrong_labels(items, model).collect()) == [(1, "en"), (1, "it"), (3, "de"), (4, "de")]


def test_mojibake_round_trip(spark, samples):
    """Clean texts garbled in known ways are found and restored exactly."""
    texts = [r.text for r in samples.orderBy("sample_id").collect()]
    clean = [t for t in texts if re.search("[à-ÿа-яćś]", t)][:120]
    garble = [lambda t: t.encode().decode("latin-1"), lambda t: t.encode().decode("cp1251", "replace") if "�" not in t.encode().decode("cp1251", "replace") else t.encode().decode("latin-1"), lambda t: t.encode().decode("mac_roman"), lambda t: t.encode().decode("latin-1").encode().decode("latin-1")]
    data = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, garble[i % 4](t)) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(data + [(5000, None), (5001, ""), (5002, "x�y"), (5003, "★★★ 🙂 °C ½ &eacute; café NÃO")], "doc_id BIGINT, text STRING").withColumn("word", F.lit(1))
    out = {r.doc_id: r.text for r in mojibake.repaired(docs, samples).collect()}
    assert set(out) == {1000 + i for i in range(len(clean))} | {5002}
    assert sum(out[1000 + i] == t for i, t in enumerate(clean)) >= 0.95 * len(clean)
    assert mojibake.damaged(docs.limit(0), samples).count() == 0


def test_reference_takes_every_word(spark):
    """Words beyond the 50,000 most frequent count too, once a distinct word."""
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnop", repeat=4), 50_200)]
    texts = [" ".join(words[k : k + 1000] * 2) for k in range(0, len(words), 1000)] + ["zzħz"]
    known = mojibake.reference(spark.createDataFrame([(t,) for t in texts], "text STRING"))
    want = Counter(p for w in [*words, "zzħz"] for p in itertools.pairwise(f" {w} "))
    assert known.pairs == want and known.total == sum(want.values()) and "ħ" in known.letters
    assert known.clean("Ħaħa".lower()) and not known.clean("ĝaħa")
    assert mojibake.reference(spark.createDataFrame([], "text STRING")).total == 1
