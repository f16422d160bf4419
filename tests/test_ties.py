"""Orders that a query's own key leaves open."""

from datetime import datetime

from dossier.plans import wiki


def test_timelines_of_level_places_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    # ids that differ by 100,003 have one place: 1 (month 5), 100,004 (month 3) and 200,007 (year only)
    rows = [(i, datetime(2024, m, 1), 7) for i, m in ((1, 5), (100_004, 3), (200_007, 1), (2, 6), (300_007 + 3, 2))]
    got = []
    for n, order in enumerate((rows, rows[::-1])):
        spark.createDataFrame(order, "event_id bigint, ts timestamp, user_id bigint").coalesce(1).write.parquet(f"{tmp_path}/{n}/events.parquet")
        got.append(sorted(tuple(r) for r in wiki.timeline_order(spark, f"{tmp_path}/{n}").collect()))
    assert got[0] == got[1]
