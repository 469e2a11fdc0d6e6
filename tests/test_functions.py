import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from virosieve.functions import changes, values
from virosieve.functions.dates import MONTH, WEEK, DateBin, collection_window, every, mid_collection_date


def column(spark, texts, kind="string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")


def evaluate(spark, texts, expression, kind="string"):
    rows = column(spark, texts, kind).select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


WINDOWS = {
    "2024": ("2024-01-01", "2024-12-31"),
    "2025-4-16": ("2025-04-16", "2025-04-16"),
    "2025-04-16": ("2025-04-16", "2025-04-16"),
    "2025-4": ("2025-04-01", "2025-04-30"),
    "2024-02": ("2024-02-01", "2024-02-29"),
    "2025-4-16T10:20:30": ("2025-04-16", "2025-04-16"),
    "2025-4-16 10:20": ("2025-04-16", "2025-04-16"),
    "2025-4-16/2025-5-17": ("2025-04-16", "2025-05-17"),
    "2025-4-16T01:02/2025-5-17T03:04": ("2025-04-16", "2025-05-17"),
    "2025/2026-2": ("2025-01-01", "2026-02-28"),
    "1-1-1": ("0001-01-01", "0001-01-01"),
    "9999": ("9999-01-01", "9999-12-31"),
}
UNREADABLE = [
    "2025-4-16/", "2025-0", "2025-1-0", "/2025-4-16", "", "abc", "2025-13", "2025-2-30", "2025-1-1-1",
    "2024/2025/2026", "0", "10000", "2025-", "-2025", "2025-02-30/2025-03-01",
]


def test_collection_window(spark):
    got = evaluate(spark, list(WINDOWS), collection_window)
    assert [(str(w.start), str(w.end)) for w in got] == list(WINDOWS.values())


def test_collection_window_unreadable(spark):
    assert evaluate(spark, UNREADABLE + [None], collection_window) == [None] * (len(UNREADABLE) + 1)


def test_mid_date_rounds_to_start(spark):
    df = spark.sql("SELECT date '2024-01-01' a, date '2024-01-04' b")
    assert df.select(mid_collection_date("a", "b")).first()[0] == dt.date(2024, 1, 2)


def test_week_label_keeps_calendar_year(spark):
    df = spark.sql("SELECT date '2024-12-30' d")
    row = df.select(*WEEK.columns("d")).select(WEEK.label().alias("l")).first()
    assert row.l == "2024-W01"
    iso = DateBin("iso_week")
    assert df.select(*iso.columns("d")).select(iso.label().alias("l")).first().l == "2025-W01"


def test_month_label(spark):
    df = spark.sql("SELECT date '2024-03-05' d UNION ALL SELECT null")
    labels = {r.l for r in df.select(*MONTH.columns("d")).select(MONTH.label().alias("l")).collect()}
    assert labels == {"2024-03", None}


def test_day_bins_floor_before_origin(spark):
    b = every(7, dt.date(2024, 1, 10))
    df = spark.sql("SELECT explode(sequence(date '2023-12-20', date '2024-01-31')) d")
    for r in df.select("d", *b.columns("d")).collect():
        assert r.bin_start <= r.d < r.bin_end
        assert (r.bin_start - dt.date(2024, 1, 10)).days % 7 == 0
        assert (r.bin_end - r.bin_start).days == 7


def test_parse_change(spark):
    got = evaluate(spark, ["PB1-F2:V56A", "HA:K3-+", "PB1:56A", "PB1:V56", "a b:V5A", "X:V5A\n", None], changes.parse_change)
    assert tuple(got[0]) == ("PB1-F2", "V", 56, "A")
    assert tuple(got[1]) == ("HA", "K", 3, "-+")
    assert got[2:] == [None] * 5
    assert changes.split_change("PB1-F2:V56A") == ("PB1-F2", "V", 56, "A")
    with pytest.raises(ValueError):
        changes.split_change("PB1:V56")


def test_clean_feature_name(spark):
    names = ["HA:cds-XAJ25415.1", "cds-XAJ25415.1", "HA:XAJ25415.1", "XAJ25415.1"]
    assert evaluate(spark, names, changes.clean_feature_name) == ["XAJ25415.1"] * 4


def test_translate_codon(spark):
    got = evaluate(spark, ["ATG", "TAA", "NTG", "AT-", "TGG", None], changes.translate_codon)
    assert got == ["M", "*", "X", None, "W", None]
    assert len(changes.CODON_TABLE) == 64


def test_mature_to_sequential(spark):
    got = evaluate(spark, [-17, -16, -1, 0, 1, 552, 553], changes.mature_to_sequential, "bigint")
    assert got == [None, 1, 16, None, 17, 568, None]


def test_values(spark):
    assert evaluate(spark, ["12", "12.0", "12.5", "", "x", None, "1e2"], values.whole_from_decimal_text) == [
        12, 12, None, None, None, None, 100,
    ]
    assert evaluate(spark, ["True", "false", "yes", "", None], values.bool_from_text) == [True, False, False, None, None]


def test_freq_bin_boundaries(spark):
    freqs = [Decimal(k) / 20 for k in range(21)]
    got = evaluate(spark, freqs, changes.freq_bin, "decimal(20,10)")
    assert got == list(range(20)) + [19]
    assert evaluate(spark, [Decimal("-0.01"), Decimal("1.01")], changes.freq_bin, "decimal(20,10)") == [None, None]
    with pytest.raises(ValueError):
        changes.freq_bin(F.lit(0.5), 7)


def test_bin_text(spark):
    got = evaluate(spark, [0, 1, 9, 19], changes.bin_text, "int")
    assert got == ["[0,0.05)", "[0.05,0.1)", "[0.45,0.5)", "[0.95,1]"]


@settings(max_examples=12, deadline=None)
@given(
    low=st.none() | st.integers(0, 40).map(lambda i: i / 40),
    high=st.none() | st.integers(0, 40).map(lambda i: i / 40),
)
def test_freq_overlap_is_interval_overlap(spark, low, high):
    condition = changes.freq_overlap(low, high)
    bins = spark.range(20).select(F.col("id").cast("int").alias("freq_bin"))
    kept = {r.freq_bin for r in (bins if condition is None else bins.filter(condition)).collect()}

    def overlaps(k):
        lo, hi, closed = Decimal(k) / 20, Decimal(k + 1) / 20, k == 19
        below = high is None or lo <= Decimal(str(high))
        above = low is None or hi > Decimal(str(low)) or (closed and hi >= Decimal(str(low)))
        return below and above

    assert kept == {k for k in range(20) if overlaps(k)}
