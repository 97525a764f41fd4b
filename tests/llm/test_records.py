import json

from lorewright.llm import facts, names

TRIPLE = "triple_seq bigint, subject string, predicate string, object string, raw string, id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "clash")[:6] if len(r) == 4 else (*r, "clash") for r in rows], TRIPLE)


def test_fact_copies(spark):
    raw = lambda **x: json.dumps(x)
    rows = [
        (5, "Ada  Lovelace", "wrote", "Notes"), (2, "ADA LOVELACE.", "(wrote)", "no-tes!"), (2, "ADA LOVELACE.", "(wrote)", "no-tes!"), (9, None, None, None, raw(Object="notes", SUBJECT="ada lovelace", predicate="wrote")),
        (3, "Ada Lovelacé", "wrote", "notes"), (4, "", "wrote", "notes"), (6, None, "wrote", "notes"), (7, " \u00a0", "wrote", "notes"), (8, None, None, None, '{"subject": "Ada'), (10, None, None, None, None), (11, "wrote", "Ada Lovelace", "notes"),
        (12, "x", "y", "z", raw(subject="ada lovelace", predicate="wrote", object="notes")),
    ]
    got = {tuple(r) for r in facts.fact_copies(table(spark, rows)).select("first_id", "id").collect()}
    assert got == {(2, 2), (2, 5), (2, 9), (3, 3), (11, 11), (12, 12)}
    assert {r["first_id"]: r["copies"] for r in facts.collapsed(table(spark, rows)).collect()}[2] == 3
    assert facts.fact_copies(table(spark, rows).limit(0)).count() == 0


def test_fingerprint_ignores_field_order(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "b")], "x string, y string")
    one = facts.fingerprint({"s": F.col("x"), "o": F.col("y")}, "k")
    two = facts.fingerprint({"o": F.col("y"), "s": F.col("x")}, "k")
    other = facts.fingerprint({"s": F.col("y"), "o": F.col("x")}, "k")
    r = df.select(one.alias("a"), two.alias("b"), other.alias("c")).first()
    assert r["a"] == r["b"] != r["c"]


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(facts, "fingerprint", lambda values, seed: F.lit(1))
    rows = [(1, "a", "b", "c"), (2, "A", "b", "c"), (3, "x", "y", "z"), (4, "X", "y", "z"), (5, "q", "q", "q")]
    got = {tuple(r) for r in facts.fact_copies(table(spark, rows)).select("first_id", "id").collect()}
    assert got == {(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)}


ENTITIES = [
    (1, "Łukasz Brisulo", "person"), (2, "Frederick M. Cacisouprian", "person"), (3, "Robert Kliabocack", "person"), (4, "Gregory Kliabocack", "person"), (5, "Richard Kliabocack", "person"),
    (10, "Veklin Water Services Ltd", "organisation"), (11, "University of Stanume", "organisation"), (12, "Thasapokle Institute of Applied Typography", "organisation"), (13, "Zakluflo Timber & Paper Cooperative", "organisation"), (14, None, "person"),
]
LINKS = {
    "Lukasz Brisulo": 1, "brisulo, ŁUKASZ": 1, "Ł. Brisulo": 1, "Dr. Brisulo": 1, "Łukasz Brislo": 1, "Łukasz Brisulo, PhD": 1, "Fred Cacisouprian": 2, "Cacisouprian F. M.": 2, "Prof. Frederick Cacisouprian": 2, "Frederick 'Freddie' Cacisouprian": 2, "Ferderick Cacisouprian": 2,
    "Bob Kliabocack": 3, "G. Kliabocack": 4, "Greg Kliabocack": 4, "R. Kliabocack": None, "Mr Kliabocack": None, "Susan Kliabocack": None, "Brisulo": None, "Robert Brisulo": None,
    "The Veklin Water Services": 10, "Veklin Water Svcs. Limited": 10, "Water Services Veklin Ltd": 10, "Vekiln Water Services": 10, "Veklin Robotics Ltd": None, "Stanume University": 11, "U. Stanume": 11, "Univ. of Stanume": 11, "University of Stanmue": 11, "University of Grelume": None,
    "Thasapokle Inst. of Appl. Typography": 12, "Institute of Applied Typography, Thasapokle": 12, "Thasapokle Institute of Applied Robotics": None, "Zakluflo Timber and Paper Co-op": 13, "zakluflo timber u. paper": 13, "Zakluflo Water Services Ltd": None, "route 331": None, "": None, " ": None,
}


#: What teaches that Bob is a Robert, Freddie a Frederick and Limited a Ltd: names that stand beside several known parts.
TEACHERS = {
    "Robert Fegrux": ["Bob Fegrux"], "Robert Drohaque": ["Bob Drohaque"], "Robert Cupria": ["Cupria, Bob"], "Frederick Sodewes": ["Frederick 'Freddie' Sodewes"], "Frederick Thalipo": ["Thalipo, Frederick (Freddie)"], "Frederick Wigriark": ["Freddie Wigriark"],
    "Brekal Grid Systems Ltd": ["Brekal Grid Systems Limited"], "Jagovos Freight Logistics Ltd": ["Jagovos Freight Logistics Limited"], "Lugefox Cold Storage Ltd": ["The Lugefox Cold Storage Limited"],
}
TAUGHT = [(100 + i, n, "organisation" if n.endswith("Ltd") else "person") for i, n in enumerate(TEACHERS)]


def test_name_links(spark):
    said = list(LINKS)
    rows = [(i, s, "met", "Łukasz Brisulo" if i == 0 else None) for i, s in enumerate(said)]
    rows += [(1000 + i, s, "met", None) for i, s in enumerate(s for x in TEACHERS.values() for s in x)]
    df = table(spark, rows)
    df = df.unionByName(df.limit(3))
    entities = spark.createDataFrame(ENTITIES + TAUGHT, "entity_id bigint, name string, kind string")
    got = {(r["id"], r["slot"]): r["entity_id"] for r in names.variant_links(df, "triple_seq", ["subject", "object"], entities).collect()}
    assert {s: got.get((i, "subject")) for i, s in enumerate(said)} == LINKS
    assert not [k for k in got if k[1] == "object"]  # the listed spelling is no variant
    assert names.variant_links(df.limit(0), "triple_seq", ["subject"], entities).count() == 0
    assert names.variant_links(df, "triple_seq", ["subject"], entities.limit(0)).count() == 0


def test_rematch_learns_spellings(spark):
    entities = spark.createDataFrame([(1, "Robert Kliabocack", "person")], "entity_id bigint, name string, kind string")
    df = table(spark, [(1, "Robert Kliabocakc", "p", "o"), (2, "R. Kliabocakc", "p", "o"), (3, "R. Klaibocack", "p", "o")])
    got = {r["id"] for r in names.variant_links(df, "triple_seq", ["subject"], entities).collect()}
    assert got == {1, 2}  # the second through what the first showed; the third is too short to be trusted alone


def test_nicknames_are_learned_only_from_several_names(spark):
    entities = spark.createDataFrame([(i, n, "person") for i, n in enumerate(["Margaret Fegrux", "Margaret Drohaque", "Margaret Cupria", "Susan Sodewes", "Thomas Wigriark", "Susan Brisulo"])], "entity_id bigint, name string, kind string")
    say = lambda *x: spark.createDataFrame([(names.squash(n),) for n in x], "key string")
    link = lambda *x: {(r["key"], r["entity_id"]) for r in names.link_names(say(*x), entities).collect()}
    assert link("Peggy Fegrux", "Peggy Drohaque") == set()
    assert link("Peggy Fegrux", "Peggy Drohaque", "Cupria, Peggy") == {("peggyfegrux", 0), ("peggydrohaque", 1), ("cupriapeggy", 2)}
    # other people of the same surname teach nothing: their given name is one of the known ones
    assert link("Thomas Sodewes", "Thomas Brisulo", "Thomas Fegrux", "Thomas Cupria") == set()


def test_middle_initials_are_unioned(spark):
    entities = spark.createDataFrame([(1, "Deborah Wigriark", "person"), (2, "Daniel Wigriark", "person")], "entity_id bigint, name string, kind string")
    say = lambda *x: spark.createDataFrame([(names.squash(n),) for n in x], "key string")
    link = lambda *x: {(r["key"], r["entity_id"]) for r in names.link_names(say(*x), entities).collect()}
    assert ("dkwigriark", 1) not in link("D. K. Wigriark", "Deborah K. Wigriark")
    assert ("dkwigriark", 1) in link("D. K. Wigriark", "Deborah K. Wigriark", "Wigriark, Deborah K.")


def test_short_and_long_parts_are_met(spark):
    entities = spark.createDataFrame([(1, "Ada Li", "person"), (2, "Robert Wolfeschlegelsteinhausenbergerdorff", "person")], "entity_id bigint, name string, kind string")
    mentions = spark.createDataFrame([(names.squash(n),) for n in ("Li, Ada", "A. Li", "Mr Li", "Robert Wolfeschlegelsteinhausenbergrdorff", "R. Wolfeschlegelsteinhausenbergerdorff", "Ali Baba")], "key string")
    got = {(r["key"], r["entity_id"]) for r in names.link_names(mentions, entities).collect()}
    assert got == {("liada", 1), ("ali", 1), ("mrli", 1), ("robertwolfeschlegelsteinhausenbergrdorff", 2), ("rwolfeschlegelsteinhausenbergerdorff", 2)}


def test_edits_against_plain_distance():
    import random

    def plain(a, b):
        d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
        for i in range(len(a)):
            for j in range(len(b)):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
                if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    rnd = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc1") for _ in range(rnd.randrange(0, 8))) for _ in range(2))
        for most in (1, 2):
            assert names.edits(a, b, most) == min(plain(a, b), most + 1), (a, b, most)


def test_edits():
    assert names.edits("abc", "acb", 2) == 1 and names.edits("abc", "abc", 2) == 0 and names.edits("abc", "xyz", 2) == 3 and names.edits("kitten", "sitting", 3) == 3


def test_hot_keys_are_joined_by_broadcast(spark):
    from pyspark.sql import functions as F

    from lorewright.llm.common import join_hot, materialize

    rows = spark.range(300).select("id", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 20).alias("k"))
    reps = materialize(rows.groupBy("k").agg(F.min("id").alias("first"), F.count("*").alias("n")), "t")
    plain = {tuple(r) for r in rows.join(reps, ["k"]).select("id", "first").collect()}
    assert {tuple(r) for r in join_hot(rows, reps, ["k"], "n", 300, parts=10, least=1).select("id", "first").collect()} == plain and len(plain) == 300


def test_one_error_in_each_part_of_a_name_is_met(spark):
    known = ["Patricia Sodewes", "Susan Cupria", "Matthew Drohaque", "Robert Fegrux"]
    said = ["Patrsicia Sodswes", "Suan Curpia", "Matrhew Droahque", "Robeert Feirux"]
    entities = spark.createDataFrame([(i, n, "person") for i, n in enumerate(known)], "entity_id bigint, name string, kind string")
    mentions = spark.createDataFrame([(names.squash(n),) for n in said], "key string")
    got = {(r["key"], r["entity_id"]) for r in names.link_names(mentions, entities).collect()}
    assert got == {(names.squash(n), i) for i, n in enumerate(said)}
