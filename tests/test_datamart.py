import pytest
from pyspark.sql import functions as F

from newsward.operators import datamart as D
from newsward.operators import records as X
from newsward.sources import mart as M


def country_dim(spark):
    return spark.createDataFrame([(1, "India"), (2, "United States")], "id bigint, country string")


def test_new_countries_take_the_first_spelling(spark):
    rows = [(1, "guinea-bissau"), (2, "INDIA"), (3, ""), (4, "Guinea-Bissau"), (5, "chad"), (6, None)]
    records = spark.createDataFrame(rows, "seq bigint, country string")
    added = D.get_or_create_countries(records, country_dim(spark), "seq").orderBy("id").collect()
    assert [tuple(r) for r in added] == [(3, "Guinea-Bissau"), (4, ""), (5, "Chad")]
    known = country_dim(spark).union(D.get_or_create_countries(records, country_dim(spark), "seq"))
    assert D.get_or_create_countries(records, known, "seq").count() == 0


def test_theme_ids(apply):
    names = ["Environmental", "'Social'", '"Governance"', "social", "Other", "", None]
    assert apply(D.theme_id, names) == [1, 2, 3, None, None, None, None]
    assert apply(D.theme_ids, [["Social", "x", "Environmental"], []], "array<string>") == [[2, 1], []]


def replied(spark):
    rows = [
        (1, "7", "Fraud", "u", '{"categories":"Social","country":"india","date":"2021-03-23","themes":["é"]}'),
        (2, "7", "Fraud", "u", '{"categories":["Environmental","Governance"],"country":"chad"}'),
        (3, "7", "Fraud", "u", '{"categories":null,"country":"CHAD"}'),
        (4, "7", "Fraud", "u", "oops"),
        (5, "7", "Fraud", "u", '{"categories":""}'),
    ]
    return spark.createDataFrame(rows, "seq bigint, company_id string, search_query string, link string, reply string")


def test_records(spark):
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    rows = X.to_records(replied(spark), "News", now, keep=("seq",)).orderBy("seq")
    assert rows.columns == ["seq", *X.RECORD_COLUMNS]
    assert tuple(rows.first()) == (
        1, "7", "News", "", "", '"Social"', '""', "2021-03-23", "u", "Fraud", '["\\u00e9"]', "india", "2024-06-01 12:00:00",
    )
    assert [r["Category"] for r in rows.collect()] == ['"Social"', '["Environmental", "Governance"]', "null"]
    api = replied(spark).withColumn("published_at", F.lit("2024-01-02T00:00:00Z"))
    dated = X.with_published_date(X.to_records(api, "NewsAPI"))
    assert {(r["Published_dt"], str(r["published_date"])) for r in dated.collect()} == {("2024-01-02T00:00:00Z", "2024-01-02")}
    assert dated.count() == 2


def test_load_twice_and_reload(spark, tmp_path):
    mart = M.ParquetMart(spark, str(tmp_path / "mart"))
    mart.write(M.COUNTRIES, country_dim(spark), "seed")
    assert mart.commit("seed", "seed", mart.snapshot())
    records = X.to_records(replied(spark), "News", keep=("seq",))
    for load_id in ("a", "b", "b"):
        M.load_datamart(mart, records, ["seq"], load_id)
    details = mart.read(M.DETAILS).orderBy("id").collect()
    assert [r["id"] for r in details] == [1, 2, 3, 4, 5, 6]
    countries = mart.read(M.COUNTRIES).orderBy("id").collect()
    assert [tuple(r) for r in countries] == [(1, "India"), (2, "United States"), (3, "Chad")]
    themes = mart.read(M.INCIDENT_THEMES).orderBy("incident_id", "theme_id").collect()
    assert [tuple(r) for r in themes] == [(1, 2), (2, 1), (2, 3), (4, 2), (5, 1), (5, 3)]
    links = mart.read(M.INCIDENT_COUNTRIES).orderBy("incident_id").collect()
    assert [tuple(r) for r in links] == [(1, 1), (2, 3), (3, 3), (4, 1), (5, 3), (6, 3)]


def test_load_without_bridges(spark, tmp_path):
    mart = M.ParquetMart(spark, str(tmp_path / "mart"))
    M.load_datamart(mart, X.to_records(replied(spark), "News", keep=("seq",)), ["seq"], "a", bridges=False)
    assert mart.read(M.DETAILS).count() == 3
    assert mart.read(M.COUNTRIES).count() == 0 and mart.read(M.INCIDENT_THEMES).count() == 0


def test_ids_do_not_depend_on_partitions(spark):
    records = X.to_records(replied(spark), "News", keep=("seq",))
    loads = [D.build_load(records.repartition(n), country_dim(spark), ["seq"], 10) for n in (1, 5)]
    first, second = (sorted((r["seq"], r["id"]) for r in load.details.collect()) for load in loads)
    assert first == second == [(1, 11), (2, 12), (3, 13)]


def tables(mart):
    names = (M.DETAILS, M.COUNTRIES, M.INCIDENT_THEMES, M.INCIDENT_COUNTRIES)
    return {name: sorted(map(tuple, mart.read(name).collect())) for name in names}


def test_an_earlier_load_is_repeated_without_changes(spark, tmp_path):
    mart = M.ParquetMart(spark, str(tmp_path / "mart"))
    records = X.to_records(replied(spark), "News", F.lit("2024-06-01 12:00:00").cast("timestamp"), keep=("seq",))
    other = records.withColumn("country", F.lit("peru"))
    M.load_datamart(mart, records, ["seq"], "a")
    M.load_datamart(mart, other, ["seq"], "b")
    before = tables(mart)
    M.load_datamart(mart, records, ["seq"], "a")
    assert tables(mart) == before


def test_a_load_that_failed_half_way_keeps_its_countries(spark, tmp_path):
    mart = M.ParquetMart(spark, str(tmp_path / "mart"))
    records = X.to_records(replied(spark), "News", F.lit("2024-06-01 12:00:00").cast("timestamp"), keep=("seq",))
    load = D.build_load(records, mart.read(M.COUNTRIES), ["seq"])
    mart.write(M.COUNTRIES, load.countries, "a")  # and no more
    first = tables(mart)[M.COUNTRIES]
    M.load_datamart(mart, records.withColumn("country", F.lit("peru")), ["seq"], "b")
    M.load_datamart(mart, records, ["seq"], "a")
    after = tables(mart)
    assert set(first) <= set(after[M.COUNTRIES])
    ids = [row[0] for row in after[M.COUNTRIES]]
    assert len(ids) == len(set(ids))
    assert {row[1] for row in after[M.INCIDENT_COUNTRIES]} <= set(ids)
    assert len({row[0] for row in after[M.DETAILS]}) == 6


@pytest.mark.parametrize("writes", [0, 1, 2, 3, 4])
def test_a_load_that_fails_between_writes_is_not_seen(spark, tmp_path, writes):
    class Failing(M.ParquetMart):
        done = 0

        def write(self, table, rows, attempt):
            if self.done == writes:
                raise OSError("disk is gone")
            self.done += 1
            super().write(table, rows, attempt)

        def commit(self, load_id, attempt, at):
            if self.done == writes:
                raise OSError("disk is gone")
            return super().commit(load_id, attempt, at)

    mart = M.ParquetMart(spark, str(tmp_path / "mart"))
    records = X.to_records(replied(spark), "News", F.lit("2024-06-01 12:00:00").cast("timestamp"), keep=("seq",))
    M.load_datamart(mart, records, ["seq"], "a")
    before = tables(mart)
    other = records.withColumn("country", F.lit("peru"))
    for load_id in ("a", "b"):  # a load run again, and a new one
        with pytest.raises(OSError):
            M.load_datamart(Failing(spark, mart.root), other, ["seq"], load_id)
        assert tables(mart) == before
    M.load_datamart(mart, other, ["seq"], "b")
    assert len({row[0] for row in tables(mart)[M.DETAILS]}) == 2 * len(before[M.DETAILS])


def test_two_loads_at_a_time_end_in_one_retry(spark, tmp_path):
    records = X.to_records(replied(spark), "News", F.lit("2024-06-01 12:00:00").cast("timestamp"), keep=("seq",))
    other = records.withColumn("country", F.lit("peru"))

    class Interleaved(M.ParquetMart):
        """Another load comes and goes while this one writes its details for the first time."""

        snapshots = 0

        def snapshot(self):
            self.snapshots += 1
            return super().snapshot()

        def write(self, table, rows, attempt):
            super().write(table, rows, attempt)
            if table == M.DETAILS and self.snapshots == 1:
                M.load_datamart(M.ParquetMart(spark, self.root), other, ["seq"], "b")

    mart = Interleaved(spark, str(tmp_path / "mart"))
    M.load_datamart(mart, records, ["seq"], "a")
    assert mart.snapshots == 2
    plain = M.ParquetMart(spark, mart.root)
    found = tables(plain)
    details, countries = [row[0] for row in found[M.DETAILS]], dict(found[M.COUNTRIES])
    assert sorted(details) == list(range(1, len(details) + 1)) and len(details) == 6
    assert len(set(countries.values())) == len(countries) and "Peru" in countries.values()
    assert {row[1] for row in found[M.INCIDENT_COUNTRIES]} <= set(countries)
    assert [*plain.snapshot().attempts] == ["b", "a"] and plain.snapshot().last == 2


def test_a_load_gives_up_when_others_never_cease(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "TRIES", 2)
    monkeypatch.setattr(M.ParquetMart, "commit", lambda *_: False)
    records = X.to_records(replied(spark), "News", keep=("seq",))
    with pytest.raises(M.LoadConflict):
        M.load_datamart(M.ParquetMart(spark, str(tmp_path / "mart")), records, ["seq"], "a")
