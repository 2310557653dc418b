import os

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import fields, masking, text, timestamps
from loomtrace.sources import catalog
from loomtrace.sources.lines import read_lines


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "text string").select(expression(F.col("text"))).first()[0]


GENERIC = "GET /var/www/x.php from 10.0.0.7 code 404 id 0xdeadbeef"


@pytest.mark.parametrize(
    "line, kind, mode, expected",
    [
        (GENERIC, "unknown", "soft", "GET /PATH from <IP> code 404 id <HEX>"),
        (GENERIC, "unknown", "aggressive", "GET /PATH from <IP> code <NUM> id <HEX>"),
        (
            'type=EXECVE msg=audit(1700000000.123:42): argc=2 a0="ls" a1="/etc"', "audit", "soft",
            'type=EXECVE msg=audit(<AUDIT_META>): argc=<NUM> a0="ls" a1="/PATH"',
        ),
        (
            "2024-01-01T00:00:01+00:00 web1 CRON[1576]: done in 12ms /tmp/a", "syslog", "soft",
            "<TS> <HOST> CRON[<PID>]: done in <DUR> /PATH",
        ),
        ("no structure 10.0.0.7", "syslog", "soft", "no structure <IP>"),
        (
            '{"reqId":"x","level":2,"app":"files","method":"GET","url":"/a?b=1","message":"user \'u\'@\'h\' at 10.0.0.1"}',
            "nextcloud", "template",
            "nextcloud app=files level=2 GET /a?<QS> exc=<NOEXC> msg=user '<USER>'@'<HOST>' at <IP>",
        ),
        ('{"app":null} ', "nextcloud", "soft", "nextcloud app=None level=<LEVEL> <METHOD> <URL> exc=<NOEXC> msg="),
        ("[1, 2] at 10.0.0.1", "nextcloud", "soft", "[1, 2] at <IP>"),
        ("  é12 12 ", "unknown", "aggressive", "é12 <NUM>"),
        (GENERIC, "unknown", "raw", GENERIC),
    ],
)
def test_masks(spark, line, kind, mode, expected):
    assert one(spark, line, lambda t: masking.mask_line(t, mode, F.lit(kind))) == expected


def test_unknown_mode_is_an_error(spark):
    with pytest.raises(ValueError):
        masking.mask_line(F.lit("x"), "hard")


def test_fields(spark):
    line = 'type=EXECVE msg=audit(1.5:2): a0="x a1=y" a1=\'q\' aa2=3'
    found = one(spark, line, lambda t: fields.field_map(t, ["a0", "a1", "a2"]))
    assert found == {"a0": "x a1=y", "a1": 'y"'}  # each key is searched by itself


@pytest.mark.parametrize(
    "value", [0.0, 1.0, 12.5, 3600.0, 0.1234567, 1e-5, 123456.7, 999999.6, 1234567.0, 0.0001, 2.5e-10]
)
def test_general_format(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(text.general_format(F.col("v"))).first()[0] == f"{value:.6g}"


def test_iso_only(spark):
    assert one(spark, "Jan 01 00:00:01 host x: y", timestamps.leading_timestamp) is None
    assert one(spark, "2024-01-01T00:00:01+02:00 host", lambda t: F.unix_micros(timestamps.leading_timestamp(t))) == 1704060001000000


def test_line_numbers_survive_file_blocks(spark, tmp_path):
    folder = tmp_path / "GPT0"
    os.makedirs(folder)
    lines = [f"line {i} é" if i % 7 else "" for i in range(1, 20001)]
    (folder / "audit.log").write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        found = read_lines(spark, str(tmp_path), max_lines=15000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(i, t) for i, t in enumerate(lines, 1) if t and i <= 15000}
    assert {(r["line_no"], r["text"]) for r in found} == want
    assert {(r["actor"], r["log_type"]) for r in found} == {("GPT0", "audit")}


def test_catalog_errors():
    assert catalog.dataset_name("WP") == "WordPress"
    assert catalog.log_key("audit.log") == "audit"
    with pytest.raises(ValueError):
        catalog.dataset_name("other")
    with pytest.raises(KeyError):
        catalog.log_key("mail")
    with pytest.raises(ValueError):
        catalog.resolve_logs("wp", "nextcloud")
