import pytest

from lattica.functions.formula import Factor, parse


def test_terms_in_order_and_once():
    f = parse("y ~ b a i.c a B")
    assert [t.name for t in f.terms] == ["b", "a", "c"]
    assert f.terms[2] == Factor("c", True)
    assert f.fe is None and f.cluster is None


def test_bases():
    f = parse("y ~ i.2.x i.0.x i.1.a i.3.a")
    assert f.terms == (Factor("x", True, 2), Factor("0.x", True), Factor("a", True, 1))


def test_interactions():
    f = parse("y ~ a&i.b c##d e#f a&i.b b&a")
    assert [t.name for t in f.terms] == ["c", "d"]
    assert [[x.name for x in c] for c in f.interactions] == [["a", "b"], ["c", "d"], ["e", "f"], ["b", "a"]]
    assert len(parse("y ~ a&&b&&c").interactions) == 4


def test_first_delimiter_only():
    assert parse("y ~ a&b#c").interactions == ((Factor("a"), Factor("b#c")),)


def test_instrument_blocks_merge():
    f = parse("y ~ x (x ~ z z2)(x ~ i.z)")
    assert f.endogenous == (Factor("x"),)
    assert f.instruments == (Factor("z", True), Factor("z2"))


def test_options():
    f = parse("wage ~ x, FE(worker firm) cluster(a) vce(cluster worker, firm)")
    assert f.fe == ("worker", "firm") and f.cluster == ("worker", "firm")
    assert parse("y ~ x, fe()").fe == ()


def test_odd_blocks_are_left_out():
    assert parse("y ~ x (z1 z2) w").instruments == ()
    assert [t.name for t in parse("y ~ x (z ~ w").terms] == ["x"]
    with pytest.raises(ValueError):
        parse("y x")
