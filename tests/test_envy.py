"""Feature envy from unresolved statements."""

import pytest
from simloom.operators import envy

FIELDS = [("Billing", "gateway", "Gateway"), ("Billing", "rate", "number"), ("Billing", "self", "Billing")]


def st(method, idx, text="", branch=False, field=None, df=None, right=None, calls=()):
    return (method, idx, idx, text, branch, field, df, right, [tuple(c) for c in calls])


def call(text, declared="", base=None, base_type=None):
    return (text, declared, base, base_type)


def tables(spark, stmts, methods):
    return (
        spark.createDataFrame(stmts, envy.STMTS), spark.createDataFrame(methods, "method long, self_class string"),
        spark.createDataFrame([(*f, 0) for f in FIELDS], "class_name string, name string, type string, seq int"),
    )


def test_accesses(spark):
    stmts = [
        st(1, 0, field=("this", "", "rate"), df=("t0", None)),  # own number: local
        st(1, 1, field=("this", "", "gateway"), df=("t1", None)),  # way to another class: nothing
        st(1, 2, field=("t1", "", "limit"), df=("t2", None)),  # of the class of the field t1 was read from
        st(1, 3, field=("t2", "unknown", "deep"), df=("t3", None)),  # t2 was read from a value of Gateway, whose class is taken
        st(1, 4, df=("rate", "this")),  # own field written
        st(1, 5, df=("nosuch", "this")),  # not declared
        st(1, 6, calls=[call("a.charge()", "Gateway"), call("a.charge()", "Gateway"), call("x.y()", "%unk", "t1", ""), call("s.trim()", "String"), call("this.z()", "", "this")]),
        st(1, 7, field=("p", "Payment", "id")),
        st(1, 8, field=("q", "", "id"), df=("q", None)),  # refers to itself
        st(1, 9, field=("u", "string | null", "length")),
        st(1, 10, field=("v", "Foo | null", "length")),
    ]
    got = envy.classified(*tables(spark, stmts, [(1, "Billing")])).where("kind <> 'other'").collect()
    assert sorted((r.idx, r.what, r.kind, r.provider) for r in got) == [
        (0, "field", "local", "Billing"), (2, "field", "foreign", "Gateway"), (3, "field", "foreign", "Gateway"), (4, "write", "local", ""),
        (6, "call", "foreign", "Gateway"), (6, "call", "foreign", "Gateway"), (7, "field", "foreign", "Payment"), (10, "field", "foreign", "Foo | null"),
    ]


def mapping(extra=(), new="t = new Request", right_of=None):
    s = [st(1, 0, new, df=("t", None), right="new"), st(1, 1, "r = t", df=("r", None), right="t", calls=[call("t.<Request.constructor()>()", "Request", "t", "Request")])]
    for i in range(5):
        s.append(st(1, 2 + 2 * i, field=("p", "Payload", f"f{i}"), df=(f"v{i}", None)))
        s.append(st(1, 3 + 2 * i, df=(f"f{i}", "r"), right=f"v{i}" if right_of != i else "w"))
    s.append(st(1, 20, calls=[call("r.send()", "Request", "r", "Request")]))
    return [*s, *extra]


@pytest.mark.parametrize(
    "stmts,pure",
    [
        (mapping(), True), (mapping([st(1, 21, branch=True)]), False), (mapping([st(1, 21, df=("rate", "this"))]), False), (mapping(new="t = make()"), False),
        (mapping(right_of=3), False), (mapping([st(1, 21, calls=[call("r.more()", "Request", "r", "Request")])]), False),
        (mapping([st(1, 21, calls=[call("o.x()", "Other", "o", "Other")])]), False), (mapping([st(1, 21, field=("z", "Other", "f"), df=("y", None)), st(1, 22, df=("f", "r"), right="y")]), False),
    ],
)
def test_pure_mapping(spark, stmts, pure):
    s, m, f = tables(spark, stmts, [(1, "Billing")])
    assert (envy.pure_mappings(s, envy.classified(s, m, f)).count() == 1) is pure


def test_envious_method(spark):
    uses = [st(1, i, calls=[call(f"g.c{i}()", "Gateway")]) for i in range(5)]
    local = [st(2, i, calls=[call(f"g.c{i}()", "Gateway")]) for i in range(5)] + [st(2, 9 + i, field=("this", "", "rate")) for i in range(4)]
    tabs = tables(spark, [*uses, *local, *[(3, *x[1:]) for x in mapping()]], [(1, "Billing"), (2, "Billing"), (3, "Adapter")])
    assert [tuple(r) for r in envy.envious_methods(*tabs).select("method", "atfd", "lda", "cpfd", "dominant").collect()] == [(1, 5, 0.0, 1, "Gateway")]
    assert envy.envious_methods(*tabs, atfd=5).count() == 0


def test_aliases(spark):
    seeds = spark.createDataFrame([(1, "a"), (2, "x")], "method long, name string")
    pairs = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "d", "e"), (2, "y", "x"), (2, "x", None)]
    got = envy.alias_closure(seeds, spark.createDataFrame(pairs, 'method long, def string, right string'))
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "x")]


def test_empty(spark):
    assert envy.envious_methods(*tables(spark, [], [(1, "A")])).count() == 0
