"""A labelled corpus of seventeen small messages: eleven with events, six without (one of them with a past event)."""

from __future__ import annotations

import base64
import zlib
from datetime import date, datetime

RECEIVED = datetime(2026, 9, 14, 10, 0)


def _b64(text: str) -> str:
    return base64.encodebytes(text.encode()).decode()


def mail(subject, body, sender="someone@example.com", ident=None, extra=(), html=None, ics=None) -> bytes:
    def word(text):
        return text if text.isascii() else "=?utf-8?B?" + base64.b64encode(text.encode()).decode() + "?="

    ident = ident or f"{zlib.crc32((subject + body).encode())}@example.com"
    head = [f"From: {sender}", "To: me@example.com", f"Subject: {word(subject)}", f"Message-ID: <{ident}>",
            "Date: Mon, 14 Sep 2026 10:00:00 +0800", "MIME-Version: 1.0", *extra]
    plain = ["Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: base64", "", _b64(body)]
    if html is not None:
        parts = [["Content-Type: text/html; charset=utf-8", "Content-Transfer-Encoding: base64", "", _b64(html)]]
    elif ics is not None:
        parts = [plain, ["Content-Type: text/calendar; charset=utf-8; method=REQUEST",
                         "Content-Transfer-Encoding: base64", "", _b64(ics)]]
    else:
        return "\n".join(head + plain).encode()
    out = [*head, 'Content-Type: multipart/mixed; boundary="b1"', ""]
    for part in parts:
        out += ["--b1", *part]
    return "\n".join([*out, "--b1--", ""]).encode()


def vevent(uid, summary, start, end, organizer, sequence=0, method="REQUEST"):
    return "\r\n".join([
        "BEGIN:VCALENDAR", "VERSION:2.0", f"METHOD:{method}", "BEGIN:VEVENT", f"UID:{uid}", f"SUMMARY:{summary}",
        f"DTSTART:{start}", f"DTEND:{end}", f"SEQUENCE:{sequence}", f"ORGANIZER;CN=Host:mailto:{organizer}",
        "END:VEVENT", "END:VCALENDAR", ""])


SAMPLES = [
    ("ics_invite", mail("Welcoming Day for new students", "You are invited to the Welcoming Day.\n\nJoin online",
                        ics=vevent("m1@meet", "Welcoming Day for new students", "20260918T020000Z",
                                   "20260918T040000Z", "host@school.example"))),
    ("domain_expiry", mail("云服务域名到期提醒", "尊敬的用户：\n\n您的域名 example.com 将于 2026年10月8日 到期，"
                           "为避免影响正常使用，请及时续费。\n\n云服务\n")),
    ("appointment", mail("入境事務處預約確認通知", "敬啟者：\n\n你已預約於 2026年9月20日 上午11時15分 前往 "
                         "總部大樓 辦理手續。\n\n請準時到達。\n")),
    ("next_wednesday", mail("面试通知", "您好，\n\n很高兴通知您，面试安排在下周三下午2点，地点为 B 座 302 会议室。\n\nHR 部\n")),
    ("form_deadline", mail("[Evaluation] Welcoming Day Evaluation Form",
                           "Dear students,\n\nPlease complete the evaluation form before 2026-09-30 23:59.\n\nOffice\n")),
    ("flight", mail("您的行程单 - 9月25日 香港往上海", "尊敬的旅客：\n\n您的航班 CX368 将于 2026年9月25日 09:30 "
                    "从香港国际机场起飞。\n请于起飞前 2 小时抵达机场。\n")),
    ("card_due", mail("信用卡账单提醒", "尊敬的客户：\n\n您的信用卡账单已出，最低还款额为 HKD 500，还款到期日为 "
                      "2026年9月28日。\n\n请于到期日前完成还款。\n")),
    ("html_only", mail("Team Sync", "", html="<html><body><p>Team Sync 将于 <b>2026年9月22日 15:00</b> 在线上举行。</p>"
                       "<p><a href='https://x.example/t?id=1'>点击加入</a></p></body></html>")),
    ("ics_update", mail("Updated invitation: Project Review", "The meeting has been rescheduled.",
                        ics=vevent("m2@meet", "Project Review", "20260921T060000Z", "20260921T070000Z",
                                   "boss@example.com", 1))),
    ("quoted_date", mail("Re: 会议安排", "确认一下，会议改到 2026年9月24日 上午10点。\n\n在 2026年8月1日 写道：\n"
                         "> 原定 2026年8月15日 的会议需要调整\n> 上次我们说的是 2025年12月20日\n")),
    ("no_year", mail("聚会安排", "我们定在 9月20日 晚上7点 聚餐吧。\n")),
    ("promo", mail("下載App即享優惠！", "優惠期至 2026年12月31日。\n\n立即下載 App，即可獲得積分。\n\n"
                   "© 2026 Example 版權所有\n如不想收到推廣郵件，請按此退訂\n",
                   extra=["List-Unsubscribe: <mailto:u@promo.example>"])),
    ("auto_reply", mail("自动回复：Re: 咨询", "您好，我目前休假中，将于 2026年9月20日 返回工作岗位。\n",
                        extra=["Auto-Submitted: auto-replied"])),
    ("past_minutes", mail("上周会议纪要", "各位好，\n\n我们于 2026年9月8日 14:00 召开的会议纪要如下：\n1. 项目进度正常\n"
                          "2. 下阶段目标已明确\n\n谢谢。\n")),
    ("code", mail("您的验证码", "您的验证码是 123456，5分钟内有效。请勿泄露给他人。\n")),
    ("plain_notice", mail("服务条款更新通知", "我们更新了服务条款，主要变更如下：\n1. 隐私政策调整\n2. 数据处理流程优化\n\n"
                          "如有疑问请联系客服。\n")),
    ("no_time", mail("想约个会", "最近想找你聊聊项目进展，方便的时候约个会议吧。\n")),
]

# name, exp_ord, title_contains, start_date, start_time, kind, tolerance_minutes
EXPECTED = [
    ("ics_invite", 0, "Welcoming Day", date(2026, 9, 18), "10:00", "event", 0),
    ("domain_expiry", 0, "域名", date(2026, 10, 8), None, "deadline", 0),
    ("appointment", 0, "預約", date(2026, 9, 20), "11:15", "event", 0),
    ("next_wednesday", 0, "面试", date(2026, 9, 23), "14:00", "event", 0),
    ("form_deadline", 0, "Evaluation", date(2026, 9, 30), None, "deadline", 60),
    ("flight", 0, "航班", date(2026, 9, 25), "09:30", "event", 0),
    ("card_due", 0, "还款", date(2026, 9, 28), None, "deadline", 0),
    ("html_only", 0, "Sync", date(2026, 9, 22), "15:00", "event", 0),
    ("ics_update", 0, "Project Review", date(2026, 9, 21), "14:00", "event", 0),
    ("quoted_date", 0, "会议", date(2026, 9, 24), "10:00", "event", 0),
    ("no_year", 0, "聚餐", date(2026, 9, 20), "19:00", "event", 0),
    ("past_minutes", 0, "会议纪要", date(2026, 9, 8), "14:00", "event", 0),
]
EXPECTED_SCHEMA = ("name string, exp_ord int, title_contains string, start_date date, start_time string, kind string, "
                   "tolerance_minutes int")
