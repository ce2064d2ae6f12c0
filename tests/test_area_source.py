import pytest

from firegrid.sources.area_api import AreaSource, QuotaError, UnavailableError, Window, fetch

BODY = "latitude,longitude,frp\n43.5,6.1,4.2\n"


def test_reads_every_window(spark, tmp_path):
    spark.dataSource.register(AreaSource)
    first = tmp_path / "A/0,40,10,45/5/2024-01-01.csv"
    first.parent.mkdir(parents=True)
    first.write_text(BODY)
    read = lambda: spark.read.format("area").option("base", str(tmp_path)).option("products", "A,B").option("bbox", "0,40,20,45").option("start", "2024-01-01").option("days", "7").load()
    rows = read().collect()
    assert len(rows) == 2 * 2 * 2 and sum(r.body == BODY for r in rows) == 1
    assert {r.request.rsplit("/", 2)[1] for r in rows} == {"5", "2"}
    first.write_text("Invalid key")
    with pytest.raises(Exception, match="not a table"):
        read().collect()


def test_answers_are_told_apart(monkeypatch):
    import io
    import urllib.error

    window = Window("A", (0, 40, 10, 45), "2024-01-01", 1)

    def answer(code, headers):
        def open_(*a, **k):
            raise urllib.error.HTTPError("u", code, "m", headers, io.BytesIO(b"Invalid day range"))

        monkeypatch.setattr("urllib.request.urlopen", open_)

    answer(429, {"Retry-After": "30"})
    with pytest.raises(QuotaError) as e:
        fetch("https://x", "secret", window)
    assert e.value.retry_after == 30
    answer(400, {})
    with pytest.raises(UnavailableError, match="400: Invalid day range") as e:
        fetch("https://x", "secret", window)
    assert "secret" not in str(e.value)
    with pytest.raises(ValueError):
        fetch("https://x", "k", Window("A", (0, 0, 1, 1), "2024-01-01", 6))
