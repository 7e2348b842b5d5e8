import pytest

from bandwright.plans import plsql


def evaluate(spark, body, **row):
    text = plsql.formula(body, lambda n: repr(row[n.lower()]) if row[n.lower()] is not None else "NULL")
    return spark.sql(f"SELECT {text} x").first().x


NESTED = "function f return number is v number := 1; begin if :a > 5 then if :b is null then v := 2; else return 7; end if; elsif :a = 3 then return nvl(:b, 0); else null; end if; return v; exception when others then return 9; end;"


@pytest.mark.parametrize(("a", "b", "x"), [(6, None, 2), (6, 1, 7), (3, None, 0), (3, 4, 4), (1, 1, 1)])
def test_nested_if_and_return(spark, a, b, x):
    assert evaluate(spark, NESTED, a=a, b=b) == x


def test_case_in_between_and_power(spark):
    body = "begin return case :a when 1 then 'one' when 2 then 'two' else 'many' end; end;"
    assert evaluate(spark, body, a=2) == "two"
    assert evaluate(spark, "begin if :a in (1, 2) and :a between 1 and 5 and not :b like 'x%' then return :a ** 2; end if; return 0; end;", a=2, b="y") == 4


def test_placeholders_in_order(spark):
    done = plsql.Compiler().compile("begin :CP_1 := :x || 'a'; if :y = 1 then :CP_2 := :CP_1; else :CP_2 := null; end if; return (1); end;")
    row = spark.sql(f"SELECT {done.placeholders['CP_1']} a, {done.placeholders['CP_2']} b FROM (SELECT 'q' x, 1 y)").first()
    assert (row.a, row.b) == ("qa", "qa")


def test_assignment_after_return_only_reaches_the_rest(spark):
    body = "v number := 1; begin if :a = 1 then return v; end if; v := 5; return v; end;"
    assert evaluate(spark, body, a=1) == 1 and evaluate(spark, body, a=2) == 5


@pytest.mark.parametrize("body", ["begin for i in 1..3 loop null; end loop; end;", "begin Pkg.Do(1); return 1; end;", "begin if :a = 1 then return 2; end;", "begin return Pkg.F_X(1); end;"])
def test_nothing_is_guessed(body):
    with pytest.raises(ValueError):
        plsql.formula(body)


def test_trigger_defaults_to_shown(spark):
    text = plsql.visibility("begin if :a > 1 then return (FALSE); else return (TRUE); end if; end;", lambda n: "CAST(NULL AS INT)")
    assert spark.sql(f"SELECT {text} x").first().x is True
