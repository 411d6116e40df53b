"""Column functions on small tables of cases."""

from datetime import date

from pyspark.sql import functions as F

from mailspark.functions import fingerprint as fp, headers as hd, text as tx, titles as tt
from mailspark.functions.dates import dates_in, times_in
from tests.conftest import rows

RECEIVED = date(2026, 9, 14)

DATES = [
    ("二零二六年十月一日 舉行", ["2026-10-01"]),
    ("十月一日（星期四）上午", ["2026-10-01"]),
    ("九月二十一日 與 十月三日", ["2026-09-21", "2026-10-03"]),
    ("2026年9月20日 和 2026/9/22", ["2026-09-20", "2026-09-22"]),
    ("2026-02-30 then 3月5日", ["2027-03-05"]),
    ("9月20日 聚餐", ["2026-09-20"]),
    ("1月5日 年会", ["2027-01-05"]),
    ("Aug 28, 2026 12:00 PM", ["2026-08-28"]),
    ("28th August, 2026", ["2026-08-28"]),
    ("28 Aug 2026", ["2026-08-28"]),
    ("see you Oct 3", ["2026-10-03"]),
    ("2月29日 见", []),
    ("明天见", ["2026-09-15"]), ("大后天见", ["2026-09-17"]), ("后天见", ["2026-09-16"]), ("see you tomorrow", ["2026-09-15"]),
    ("下周三下午", ["2026-09-23"]), ("本周三", ["2026-09-16"]), ("周一", ["2026-09-21"]), ("下個星期日", ["2026-09-27"]),
    ("活动（星期四）", []), ("no date 12:30", []),
]

TIMES = [
    ("下午3点", ["15:00"]), ("上午十時三十分", ["10:30"]), ("下午三時正 到 晚上七點", ["15:00", "19:00"]),
    ("15:00 and 15:00:30", ["15:00"]), ("3pm", ["15:00"]), ("3:30 pm", ["15:30"]), ("12:30 PM", ["12:30"]), ("12 am", ["00:00"]),
    ("中午11点", ["11:00"]), ("中午12点", ["12:00"]), ("中午1点", ["13:00"]), ("凌晨12点", ["00:00"]), ("99点", []),
    ("上午11時15分 或 14:05", ["11:15", "14:05"]), ("二十三點五十九分", ["23:59"]), ("nothing", []),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    found = dates_in(F.col("t"), F.lit(RECEIVED))
    got = rows(df.select("i", F.transform(found, lambda d: d["day"].cast("string")).alias("d")), "i")
    assert {DATES[r["i"]][0]: r["d"] for r in got} == dict(DATES)


def test_times(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string")
    shown = F.transform(times_in(F.col("t")), lambda x: F.format_string("%02d:%02d", x["h"], x["mi"]))
    got = rows(df.select("i", shown.alias("x")), "i")
    assert {TIMES[r["i"]][0]: r["x"] for r in got} == dict(TIMES)


BODIES = [
    ("hello\r\nworld\rend", "hello\nworld\nend"),
    ("keep\n\n-- \nsignature", "keep"),
    ("keep\n> quoted\n>> more\nafter", "keep\n quoted\n more\nafter"),
    ("答复\n在 2026年8月1日 写道：\n旧内容", "答复"),
    ("body\n\nSent from my phone", "body"),
    ("body\nThis email is confidential and more", "body"),
    ("_____\nFrom: a@x\nSubject: s\n\nreal content", "real content"),
    ("\x1b[31mred\x1b[0m\x07", "red"),
    ("升旗禮\n\n上午十時三十分 | 中央廣場\n\n聯絡我們", "升旗禮\n\n上午十時三十分 | 中央廣場\n\n聯絡我們"),
    ("real\n\nshort line\n\n© 2026 Example\n\nunsubscribe here", "real"),
    ("about 退订 in the middle\n\nlast sentence here, a body with a full stop.", "about 退订 in the middle\n\nlast sentence here, a body with a full stop."),
    ("", ""),
]


def test_clean_body(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BODIES)], "i int, t string")
    got = rows(df.select("i", tx.clean_body(F.col("t")).alias("c")), "i")
    assert [r["c"] for r in got] == [c for _, c in BODIES]


def test_text_helpers(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("v")).first()["v"]

    assert value(tx.redact(F.lit("a.b@x.com 13812345678 6222020200112233445 x"))) == "[邮箱] [手机] [卡号] x"
    assert value(tx.html_to_text(F.lit(
        "<head><title>t</title></head><p>a <a href='x'> link <b>bold</b> </a>b</p>x<br>y &amp;lt; &#20013;&#x4e2d; &nope;<script>1</script>"))) == (
        "a link boldb\nx\ny &lt; 中中 &nope;")
    assert value(tx.sanitize_text(F.lit("abcdef"), 3)) == "abc…"
    assert value(tx.head_excerpt(F.lit("  a \n b "))) == "a b"
    assert value(hd.normalize_message_id(F.lit(" <Ab@EXAMPLE.com> (x)"))) == "Ab@example.com"
    assert value(hd.normalize_message_id(F.lit("<no-at>"))) is None
    assert value(hd.parse_references(F.lit("<a@B> x <c@D>"))) == ["a@b", "c@d"]
    assert value(fp.normalize_title(F.lit("Re: [fwd] 【重要】 Ｍeeting  Plan"))) == "meeting plan"
    assert value(fp.title_similarity(F.lit("开学典礼仪式"), F.lit("开学典礼"))) == 1.0
    assert value(fp.title_similarity(F.lit("a b"), F.lit("a b"))) == 0.0
    assert value(fp.normalize_ts_text(F.lit("2026-09-20T10:00:59+08:00"))) == "2026-09-20 10:00"
    assert value(tt.subject_title(F.lit("[Important Reminder] Invitation: Orientation Ceremony on 7 September 2026"))) == "Orientation Ceremony"
    assert value(tx.is_footnote(F.lit("*截至 2025 年 12 月 31 日"))) is True
    assert value(tt.clean_fragment(F.lit("会议改到 2026年9月24日 上午10点"))) == "会议"
