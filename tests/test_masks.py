import datetime as dt

import pytest

from bandwright.functions import masks


@pytest.mark.parametrize(
    ("mask", "pattern", "case"),
    [
        ("DD-MON-YYYY", "dd-MMM-yyyy", "upper"),
        ("DD-Mon-YYYY", "dd-MMM-yyyy", ""),
        ("MM/DD/YYYY", "MM/dd/yyyy", ""),
        ("fmMonth DD, RRRR HH:fmMI AM", "MMMM d, yyyy h:mm a", ""),
        ("day", "EEEE", "lower"),
        ('YYYY"-Q"Q', "yyyy'-Q'q", ""),
    ],
)
def test_date_masks(mask, pattern, case):
    assert masks.date_pattern(mask) == (pattern, case) and masks.is_date_mask(mask)


@pytest.mark.parametrize(
    ("mask", "value", "shown"),
    [
        ("$99G990D00", 8017.25, "$8,017.25"),
        ("99G990", 64005, "64,005"),
        ("90.9%", 7.5, "7.5%"),
        ("0000000", 318, "0000318"),
        ("99990MI", -71, "71-"),
        ("990PR", -640, "<640>"),
        ("9,990.00", 0.625, "0.63"),
        ("9.9EEEE", 70500.0, "7.1E04"),
    ],
)
def test_number_masks(spark, mask, value, shown):
    assert spark.sql(f"SELECT {masks.number_text(f'cast({value} as double)', mask)} x").first().x == shown


def test_unknown_mask_leaves_the_value(spark):
    assert masks.number_pattern("XYZ") is None
    assert spark.sql(f"SELECT {masks.number_text('12', 'XYZ')} x").first().x == "12"


def test_date_text(spark):
    d = spark.createDataFrame([(dt.date(2024, 3, 7),)], "d date")
    assert d.selectExpr(masks.date_text("d", "DD-MON-YYYY")).first()[0] == "07-MAR-2024"
    assert d.selectExpr(masks.date_text("d", "fmMonth DD, YYYY")).first()[0] == "March 7, 2024"
