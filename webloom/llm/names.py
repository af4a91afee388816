"""Variant spellings of the names of people and organisations.

A spelling is read into tokens (``read_name``): bylines, honorifics and roles
fall away, inverted forms are turned round, and spellings that name two or a desk
are set aside. Spellings with the same tokens are one node. Nodes are compared
through a symmetric-delete index: two tokens at most one edit apart share a form
with at most one letter deleted, so a key is one token's deletion (in names of three
tokens and more also those of two) beside the other tokens as they are. Candidates are
verified by the best assignment of tokens, which permits nicknames and typos: one, and
two from three tokens on. Spellings whose letters agree but for the place of a space, and
organisations' but for one letter more, meet under their letters without spaces.

Given names stand out as tokens with many partners. Two such tokens are no typos of
each other, which keeps relatives apart, unless one has ``TYPO`` times the partners:
a common name's typos have many partners too. Forms with initials join the
one entity they fit and stay apart where several fit.

Defined results: null and empty strings, roles and strings naming two have no
entity; single words only equal themselves; names of any number of tokens are compared.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.graphs import components
from webloom.session import stored

# Short forms of given names and what they stand for.
NICKNAMES = {
    "alex": "alexander alexandra", "andy": "andrew", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "beppe": "giuseppe", "bert": "albert robert", "beth": "elizabeth",
    "betty": "elizabeth", "bill": "william", "bob": "robert", "charlie": "charles charlotte", "chris": "christopher christina", "dan": "daniel", "dave": "david", "dick": "richard",
    "dora": "dorothea theodora", "ed": "edward", "eddie": "edward", "fred": "frederick alfred", "fritz": "friedrich", "gabi": "gabriela gabriele", "greg": "gregory", "gus": "augustin gustavo augustus",
    "hannes": "johannes", "hans": "johannes", "harry": "henry harold", "jack": "john", "jim": "james", "joe": "joseph", "josie": "josephine", "kate": "katharina katherine",
    "kathi": "katharina", "lena": "magdalena helena", "lotte": "charlotte", "leo": "leonardo leonard", "liz": "elizabeth", "lou": "louis louise", "maggie": "margaret", "manolo": "manuel", "matt": "matthew",
    "meg": "margaret", "mike": "michael", "moni": "monika", "nate": "nathaniel nathan", "nick": "nicholas", "nina": "antonina", "paco": "francisco", "pat": "patricia patrick",
    "peggy": "margaret", "pepe": "jose", "rick": "richard", "rob": "robert", "sam": "samuel samantha", "sandy": "alexandra", "sepp": "josef", "steffi": "stephanie",
    "steve": "stephen", "sue": "susanne susan", "susi": "susanne", "ted": "theodore edward", "tim": "timothy", "tina": "christina", "tom": "thomas", "toni": "antonia anton",
    "tony": "anthony antonio", "trish": "patricia", "uli": "ulrike ulrich", "vale": "valentina", "vicky": "victoria", "will": "william", "zach": "zacharias zachary",
}
# Kinds of organisations with their abbreviations, and legal forms.
KINDS = {
    "agency": "agcy agy", "association": "assoc assn ass", "broadcasting": "bcast brdcst", "company": "co comp", "corporation": "corp", "federation": "fed", "foundation": "fdn found",
    "group": "grp", "institute": "inst", "international": "intl int", "media": "med", "network": "netw", "news": "nws", "office": "off", "press": "prs", "publishing": "publ pub",
    "radio": "rad", "research": "res rsch", "service": "svc serv", "society": "soc", "studio": "", "syndicate": "synd", "television": "tv", "union": "", "university": "univ",
}
LEGAL = frozenset("ltd limited inc llc plc gmbh ag sa spa srl bv nv oy the".split())
ROLES = frozenset(
    "staff senior junior chief deputy managing foreign local political science sports culture news editor editors reporter reporters writer writers correspondent contributor contributors columnist author authors guest anonymous admin administrator webmaster newsroom editorial team desk office bureau redaktion kulturredaktion sportredaktion redaction redaccion redacao redazione redactie redakcja редакция la our the unknown by from special freelance".split()
)
HONORIFICS = frozenset("dr prof professor mr mrs ms miss sir dame herr frau dipl ing mag sra sr dra".split())
# What may follow a person's name after a comma.
SUFFIXES = frozenset("jr sr ii iii iv phd md mba".split())
#: A given name has at least so many times the partners of its typos.
TYPO = 8
_BYLINE = re.compile(r"^\s*(?:by|par|por|von|door|text|words by|story by|автор)\s*:?\s+(?=\S)", re.I)
_TWO = re.compile(r"\s*[/&;+|]\s*|\s+(?:and|And|AND|und|UND|et|y|e|oraz|и)\s+")
#: An organisation for several things: what follows the conjunction belongs to it.
_FOR = re.compile(r"\b(?:for|of|für|pour|para|per|voor|dla|для)\b[^/&;+|]*\s(?:and|und|et|y|e|en|i|и)\s[^/&;+|]*$", re.I)
_PREPOSITIONS = frozenset("for of für pour para per voor dla для".split())
_LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "ı": "i"})
_ABBREVIATED = {a: k for k, short in KINDS.items() for a in (k, *short.split())}
_JOINED = {a + b: (a, b) for a in KINDS for b in KINDS}


def within_one(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion, substitution or swap apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[i + 1 :] == shorter[i:]


def _tokens(text: str) -> list[str]:
    text = re.sub(r"['’`]", "", text)
    text = re.sub(r"(?<=[a-zà-ÿа-я])(?=[A-ZА-Я])", " ", text)
    return re.findall(r"[^\W\d_]+", text.lower())


def _is_role(tokens: list[str]) -> bool:
    return all(t in ROLES or t in HONORIFICS for t in tokens)


def _organisation(tokens: list[str]) -> tuple[list[str], list[str]] | None:
    """(name, kinds) if the tokens name an organisation."""
    split = [x for t in tokens for x in (_JOINED[t] if t in _JOINED else (t,))]
    if not any(t in KINDS for t in split) or len(split) < 2:
        return None
    name, kinds = [], []
    for t in split:
        near = _ABBREVIATED.get(t) or next((k for k in KINDS if len(t) >= 4 and within_one(t, k)), None)
        if near:
            kinds.append(near)
        elif t not in LEGAL:
            name.append(t)
    return (sorted(name), sorted(kinds)) if name else None


def read_name(text: str | None) -> tuple[str, list[str], str] | None:
    """(form, tokens, letters): form is ``o`` organisation (name tokens, then its kinds
    joined by +), ``p`` full name (sorted tokens), ``i`` surname and initials, ``s`` a
    single word; letters are the tokens in a row. None for what names nobody or more
    than one."""
    if not text or not text.strip():
        return None
    folded = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_LETTERS)) if not unicodedata.combining(c))
    folded = _BYLINE.sub("", re.sub(r"\s+", " ", folded).strip())
    joined = _FOR.search(folded)
    parts = [folded] if joined and any(t in KINDS for t in _tokens(folded[: joined.start()])) else [p for p in _TWO.split(folded) if p.strip()]
    parts = [p for p in parts if not _is_role(_tokens(p))]
    if len(parts) != 1:
        return None
    pieces = [t for p in parts[0].split(",") if (t := _tokens(p)) and not _is_role(t)]
    pieces = [q for t in pieces if (q := [x for x in t if x not in HONORIFICS])]
    while len(pieces) > 1 and all(t in SUFFIXES or t in LEGAL for t in pieces[-1]):
        pieces.pop()
    if not pieces:
        return None
    whole_of = lambda t: sum(len(x) > 1 for x in t)
    if len(pieces) == 1:
        tokens = pieces[0]
    elif any(t in KINDS for t in pieces[0]) and any(t in _PREPOSITIONS for t in pieces[0]):
        tokens = [x for t in pieces for x in t]  # a list within an organisation's name
    elif whole_of(pieces[0]) == 1 and sum(map(len, pieces[1:])) <= 4 and sum(map(whole_of, pieces[1:])) <= 2 and all(whole_of(t) == 0 for t in pieces[2:]) and not _organisation(pieces[0]):
        tokens = [x for t in pieces[1:] for x in t] + pieces[0]  # surname, given names
    else:
        return None
    letters = "".join(tokens)
    if found := _organisation(tokens):
        return "o", [*found[0], "+".join(found[1])], letters
    whole = [t for t in tokens if len(t) > 1]
    initials = [t for t in tokens if len(t) == 1]
    if len(whole) >= 2:
        return "p", sorted(whole), letters
    if whole and initials:
        return "i", [whole[0], "".join(initials)], letters
    return ("s", whole, letters) if whole else None


def deletions(token: str) -> set[str]:
    """The token and, from four letters on, its forms with one letter deleted."""
    return {token} | ({token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) >= 4 else set())


def formal(token: str) -> list[str]:
    return [token, *NICKNAMES.get(token, "").split()]


def index_keys(form: str, tokens: list[str]) -> set[str]:
    """Keys under which forms that may be the same entity meet."""
    keys: set[str] = set()
    head = "p"
    if form == "o":
        head, tokens = f"o|{tokens[-1]}", tokens[:-1]
    elif form != "p":
        return keys

    def put(own: list[str]) -> None:
        for n in (1, 2) if len(own) >= 3 else (1,):
            for at in combinations(range(len(own)), n):
                rest = [t for i, t in enumerate(own) if i not in at]
                for v in deletions(own[at[0]]):
                    for w in deletions(own[at[1]]) if n == 2 else ("",):
                        keys.add(f"{head}|{' '.join(sorted([v, *([w] if n == 2 else []), *rest]))}")

    put(tokens)
    if form == "p":
        for i, t in enumerate(tokens):
            for nick in formal(t)[1:]:
                put(tokens[:i] + [nick] + tokens[i + 1 :])
    return keys


def initial_keys(form: str, tokens: list[str]) -> set[str]:
    """Keys under which a surname with an initial meets full names."""
    if form == "i":
        return {f"{v}|{tokens[1][0]}" for v in deletions(tokens[0])}
    return {f"{v}|{f[0]}" for i, t in enumerate(tokens) for v in deletions(t) for o in tokens[:i] + tokens[i + 1 :] for f in formal(o)}


def assignment(cost: list[list[float]]) -> float:
    """The least sum of a square table with one entry a row and column: rows are added one
    by one, each along a shortest augmenting path over reduced costs."""
    n = len(cost)
    row_price, column_price = [0.0] * (n + 1), [0.0] * (n + 1)
    owner = [0] * (n + 1)  # of each column, from 1; column 0 holds the row being added
    for row in range(1, n + 1):
        owner[0], at = row, 0
        slack, came, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[at]:
            done[at] = True
            best, step = float("inf"), 0
            for j in range(1, n + 1):
                if done[j]:
                    continue
                reduced = cost[owner[at] - 1][j - 1] - row_price[owner[at]] - column_price[j]
                if reduced < slack[j]:
                    slack[j], came[j] = reduced, at
                if slack[j] < best:
                    best, step = slack[j], j
            for j in range(n + 1):
                if done[j]:
                    row_price[owner[j]] += best
                    column_price[j] -= best
                else:
                    slack[j] -= best
            at = step
        while at:
            owner[at], at = owner[came[at]], came[at]
    return sum(cost[owner[j] - 1][j - 1] for j in range(1, n + 1))


def same_name(form: str, a: list[str], b: list[str], given_a: dict[str, int] | None = None, given_b: dict[str, int] | None = None) -> bool:
    """Whether two full names or organisations agree under the best assignment of
    their tokens, with at most one typo, two from three tokens on. ``given_*`` are the
    tokens known as given names with their numbers of partners."""
    given_a, given_b = given_a or {}, given_b or {}
    if form == "o":
        if a[-1] != b[-1]:
            return False
        a, b = a[:-1], b[:-1]
    if len(a) != len(b):
        return False

    def cost(x: str, y: str) -> float:
        if x == y:
            return 0
        if set(formal(x)) & set(formal(y)):
            return 0.01
        if x in given_a and y in given_b and max(given_a[x], given_b[y]) < TYPO * min(given_a[x], given_b[y]):
            return 9
        near = len(x) >= 4 and len(y) >= 4 and any(within_one(p, q) for p in formal(x) for q in formal(y))
        return 1 if near else 9

    return assignment([[cost(x, y) for y in b] for x in a]) < (2 if len(a) < 3 else 3)


def fits_initial(initial: list[str], full: list[str]) -> bool:
    """Whether a surname with initials can be this full name: the first initial and as many
    others as there are names for stand for different ones of its other names."""
    surname, letters = initial
    for i, t in enumerate(full):
        if t == surname or (len(t) >= 5 and len(surname) >= 4 and within_one(t, surname)):
            others = full[:i] + full[i + 1 :]
            for k, o in enumerate(others):
                if any(f[0] == letters[0] for f in formal(o)):
                    rest = others[:k] + others[k + 1 :]
                    open_ = list(letters[1:])
                    left = [o for o in rest if not next((open_.remove(f[0]) or True for f in formal(o) if f[0] in open_), False)]
                    if not open_ or not left:
                        return True
    return False


_NODE = "node STRING, form STRING, tokens ARRAY<STRING>"
_TOKENS = pa.list_(pa.string())


def _parsed(names: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [(n, *r) for n in batch.column(0).to_pylist() if (r := read_name(n))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([f"{r[1]} {' '.join(r[2])}" for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], _TOKENS), pa.array([r[3] for r in rows])], names=["name", "node", "form", "tokens", "letters"])

    return names.mapInArrow(run, f"name STRING, {_NODE}, letters STRING")


def _keyed(nodes: DataFrame, make) -> DataFrame:
    """(key, node, form, tokens, given) under each of the keys ``make`` gives."""

    def run(batches):
        for batch in batches:
            keys, at = [], []
            for i, (form, tokens) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = make(form, tokens)
                keys += own
                at += [i] * len(own)
            if at:
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(took) for c in batch.columns)], names=["key", *batch.schema.names])

    return nodes.mapInArrow(run, f"key STRING, {_NODE}, given ARRAY<STRING>")


def _numbers(given: list[str] | None) -> dict[str, int]:
    return {t: int(n) for t, n in (g.split(" ") for g in given or ())}


def _checked(pairs: DataFrame, test) -> DataFrame:
    """(a, b) of the candidate pairs that pass."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            kept = [i for i, (_, _, form, x, y, gx, gy) in enumerate(zip(*cols)) if test(form, x, y, _numbers(gx), _numbers(gy))]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "form", "ta", "tb", "ga", "gb").mapInArrow(run, "a STRING, b STRING")


def _sides(keyed: DataFrame, mine: str) -> DataFrame:
    return keyed.select("key", F.col("node").alias(mine), F.col("form").alias(f"form_{mine}"), F.col("tokens").alias(f"t{mine}"), F.col("given").alias(f"g{mine}"))


def _spaced(names: DataFrame) -> DataFrame:
    """(a, b) of the nodes whose letters without spaces agree, for organisations but for one."""

    def run(batches):
        for batch in batches:
            keys, at = [], []
            for i, (form, letters) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = deletions(letters) if form == "o" else {letters}
                keys += own
                at += [i] * len(own)
            if at:
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(took) for c in batch.columns)], names=["key", *batch.schema.names])

    keyed = names.where("form IN ('p', 'o')").select("node", "form", "letters").distinct().mapInArrow(run, "key STRING, node STRING, form STRING, letters STRING")
    one, two = (keyed.select("key", F.col("form"), F.col("node").alias(n), F.col("letters").alias(f"l{n}")) for n in ("a", "b"))
    met = one.join(two, ["key", "form"]).where("a < b").select("a", "b", "form", "la", "lb").distinct()

    def test(batches):
        for batch in batches:
            kept = [i for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())) if within_one(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(test, "a STRING, b STRING")


def entities(rows: DataFrame, column: str = "author", partners: int = 4) -> DataFrame:
    """(name, entity): every distinct spelling that names one person or
    organisation. Tokens with at least ``partners`` partners (different other parts of
    their names) are given names."""
    names = stored(_parsed(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct()), "names")
    nodes = names.select("node", "form", "tokens").distinct()
    pairs = nodes.where("form = 'p'").select("node", F.posexplode("tokens").alias("i", "token"), "tokens")
    partner = pairs.select("token", F.array_join(F.array_except("tokens", F.array("token")), " ").alias("other")).where("other <> ''").distinct()
    given = partner.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= partners)
    marked = pairs.join(given, "token").groupBy("node").agg(F.collect_set(F.concat_ws(" ", "token", "n")).alias("given"))
    nodes = stored(nodes.join(marked, "node", "left").select("node", "form", "tokens", "given"), "nodes")

    full = _keyed(nodes.where("form IN ('p', 'o')"), index_keys)
    met = _sides(full, "a").join(_sides(full, "b"), "key").where("a < b").withColumn("form", F.col("form_a")).dropDuplicates(["a", "b"])
    edges = _checked(met, same_name).union(_spaced(names))
    label = stored(components(nodes.select("node", F.col("node").alias("entity")), edges, "entity"), "entities")

    short, people = nodes.where("form = 'i'"), nodes.where("form = 'p'")
    met = _sides(_keyed(short, initial_keys), "a").join(_sides(_keyed(people, initial_keys), "b"), "key").withColumn("form", F.lit("i")).dropDuplicates(["a", "b"])
    fits = _checked(met, lambda form, x, y, gx, gy: fits_initial(x, y)).join(label.withColumnRenamed("node", "b"), "b")
    only = fits.groupBy("a").agg(F.min("entity").alias("whole"), F.max("entity").alias("_last")).where("whole = _last").select(F.col("a").alias("node"), "whole")
    known = label.join(only, "node", "left").select("node", F.coalesce("whole", "entity").alias("entity"))
    return names.select("name", "node").join(known, "node").select("name", "entity")


def variant_pairs(rows: DataFrame, column: str = "author") -> DataFrame:
    """(name_a, name_b), name_a < name_b: spellings of one entity."""
    found = stored(entities(rows, column), "spellings")
    other = found.select(F.col("name").alias("name_b"), "entity")
    return found.select(F.col("name").alias("name_a"), "entity").join(other, "entity").where("name_a < name_b").select("name_a", "name_b")
