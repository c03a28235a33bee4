"""Rule packs from tables: equal to the built-in variants, extended, refused; strict bodies; leaves behind escapes."""
import json

import pytest
from pyspark.sql import functions as F

from veilspan.operators import govern as G
from veilspan.operators import redact as R
from veilspan.operators import rulepack as P
from veilspan.operators import strictness as K
from veilspan.plans.base import profiles

SF = "/root/testdata/sf0.001"
OWN = ("case_file", "case_file", r"EXP-(\d{4,6})", 2, "[CASE]", "has EXP-")


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), P.SCHEMA)


def red(spark, texts, pack, **declared):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r.out for r in P.redact(df, "text", "out", pack, **declared).orderBy("id").collect()]


@pytest.mark.parametrize("variant", ["A", "B", "C"])
def test_builtin_pack_equals_builtin_rules(spark, variant):
    extra = "Zona 10, 5a avenida 3-20. NIT 1234567-8, DPI 2345 67890 0101, 1950-2020. Soy Ana Pérez. Dr. Juan Soto."
    rows = [(r.id, f"{r.achievements}\n{r.offer}\n{extra}", r.employer, r.name, [r.current_salary]) for r in profiles(spark, SF).where("id < 40").collect()]
    df = spark.createDataFrame(rows, "id long, text string, employer string, name string, amounts array<double>")
    pack = P.load(P.builtin(spark, variant), variant)
    declared = {"employer": "employer", **({"own_name": "name"} if variant == "C" else {"amounts": "amounts"})}
    one = {"A": R.redact_a, "B": R.redact_b, "C": R.redact_c}[variant](df, "text", "out", **declared)
    two = P.redact(df, "text", "out", pack, **declared)
    one, two = ({r.id: r.out for r in d.select("id", "out").collect()} for d in (one, two))
    assert one == two and all(one[r[0]] != r[1] for r in rows)


@pytest.mark.parametrize("variant", ["A", "B", "C"])
def test_own_kind(spark, variant):
    pack = P.load(P.builtin(spark, variant).unionByName(rules(spark, OWN)), variant)
    mail = {"A": "[correo]", "B": "[CORREO]", "C": "[CORREO]"}[variant]
    assert red(spark, ["a@b.com vs EXP-12345", "EXP-1", None], pack) == [f"{mail} vs [CASE]", "EXP-1", None]


def test_terms(spark):
    rows = [
        ("grp", "code", r"code (\w+)", 1, "[C]", "group 1"), ("acc", "word", r"cancion", 2, "[W]", "on folded"),
        ("yr", "number", r"\d{4}", 3, "[N]", "digits & unless ^19"), ("stem", "pet", r"gat\w+", 4, "[P]", "stems gat"),
    ]
    for variant in "ABC":
        pack = P.load(rules(spark, *rows), variant)
        assert red(spark, ["a code xyz", "Canción", "in 1999 or 2001", "gatito"], pack) == ["a code [C]", "[W]", "in 1999 or [N]", "[P]"]


def test_a_rule_left_out_finds_nothing(spark):
    pack = P.load(P.builtin(spark, "A").where("rule_id not in ('email', 'amounts', 'known_amounts')"), "A")
    assert red(spark, ["a@b.com gana Q12,000", "NIT 1234567-8"], pack) == ["a@b.com gana Q12,000", "[NIT]"]


def test_faults_are_named(spark):
    rows = [
        ("a", "k", "(", 1, "[K]", None), ("a", "k", "x*", 2, "", None), ("b", "m", "x", 1, "[M]", "group 1 & tolerant"), ("c", "n", "@nothing", 1, "[N]", "digits"),
        ("d", "o", "y", None, "[O]", "check none & like ["),
    ]
    with pytest.raises(P.PackError) as e:
        P.load(rules(spark, *rows), "C")
    for part in ("a: pattern: ", "a: rule_id is empty or used twice", "a: tag is empty", "a: priority is missing or differs", "a: pattern matches the empty text", "b: group 1 is not in the pattern",
                 "b: unknown term tolerant", "c: no detector @nothing in variant C", "c: a detector takes no guard", "d: priority", "d: no check none", "d: like: "):
        assert part in str(e.value)


# ------------------------------------------------------------------ strict bodies
def reasons(spark, bodies, node):
    df = spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "id long, body string")
    rows = df.select("id", K.refusal(F.col("body"), node).alias("r")).orderBy("id").collect()
    return [None if r.r is None else (r.r.reason, r.r.path) for r in rows]


def test_strict_bodies(spark):
    ok = {"must": ["a"], "nice": [], "keywords": ["k"], "other": {"free": 1}}
    bodies = [ok, {**ok, "must": [""]}, {**ok, "nice": ["x"] * 13}, {**ok, "keywords": ["a", 3]}, {**ok, "must": None}, {"must": [], "nice": []}, None, "", "[1", '{"must":1,"must":2}', "7"]
    assert reasons(spark, bodies, K.REQUIREMENTS) == [
        None, ("too_short", "$.must[0]"), ("too_many", "$.nice"), ("type", "$.keywords[1]"), ("type", "$.must"), ("missing", "$.keywords"),
        ("invalid_json", "$"), ("invalid_json", "$"), ("invalid_json", "$"), ("invalid_json", "$"), ("type", "$"),
    ]


def test_strict_numbers_and_lists(spark):
    node = K.Record({"n": K.Number(least=1, most=10, whole=True), "x": K.Number(above=0), "s": K.OneOf(("a", "b")), "l": K.Items(K.Items(K.Text(1), 2))}, frozenset({"x", "s", "l"}))
    bodies = [{"n": 1}, {"n": 1.0}, {"n": 1.5}, {"n": 0}, {"n": 11}, {"n": True}, {"n": "1"}, {"n": 1, "x": 0}, {"n": 1, "x": 1e-9}, {"n": 1, "s": "c"}, {"n": 1, "s": 1},
              {"n": 1, "l": [["a"], ["b", ""]]}, {"n": 1, "l": [[], ["a", "b", "c"]]}, {"n": 1, "z": 1, "b": 2}]
    assert reasons(spark, bodies, node) == [
        None, None, ("not_whole", "$.n"), ("value", "$.n"), ("value", "$.n"), ("type", "$.n"), ("type", "$.n"), ("value", "$.x"), None, ("not_listed", "$.s"), ("type", "$.s"),
        ("too_short", "$.l[1][1]"), ("too_many", "$.l[1]"), ("unknown_key", "$.b"),
    ]


def test_leaves_behind_escapes(spark):
    body = r'{"z":"\"}}\" {","b":{"c":{"d":{"mail":"x@y.com"}}}}'
    out = {(r.path, r.text) for r in G.walk_leaves(spark.createDataFrame([(1, body)], "id long, body string"), "id", "body").collect()}
    assert out == {("$.<key>", "z"), ("$.<key>", "b"), ("$.z", '"}}" {'), ("$.b.<key>", "c"), ("$.b.c.<key>", "d"), ("$.b.c.d.<key>", "mail"), ("$.b.c.d.mail", "x@y.com")}


def test_bodies_nested_beyond_the_bound_are_one_leaf(spark):
    deep = "[" * 500 + '"x@y.com"' + "]" * 500
    rows = G.walk_leaves(spark.createDataFrame([(1, deep), (2, '["a"]')], "id long, body string"), "id", "body").collect()
    assert {(r.id, r.path, r.text) for r in rows} == {(1, "$", deep), (2, "$[0]", "a")}
