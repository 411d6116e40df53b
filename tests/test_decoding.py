"""Bytes to text: declarations, undeclared charsets, encoded words, address lists."""

import base64

import pytest

from mailspark.sources.decoding import Bigrams, Mailbox, decoded, header_text, learn_charsets, mailboxes, to_text
from mailspark.sources.raw import take_apart

SENTENCES = ["Die Übung beginnt um acht, danach können alle größeren Gruppen über den Fluß gehen.",
             "L'été dernier, nous avons mangé des pâtes à la forêt près de l'église où il était né.",
             "El niño comió una piña mañana por la tarde, según dijo el señor Muñoz en León.",
             "The meeting is moved to the old café on Monday; the façade is naïve and rosé is served."]


@pytest.fixture(scope="module")
def model(spark):
    texts = [(f"{s} {k}",) for s in SENTENCES for k in range(30)] + [(None,), ("",), ("只有汉字",)]
    return learn_charsets(spark.createDataFrame(texts, "text string"))


def test_declared_national_charsets_are_read_as_their_larger_sets():
    assert to_text("会议鎔".encode("gbk"), "GB2312") == "会议鎔" and to_text("㐀会".encode("gb18030"), "gb_2312") == "㐀会"
    assert to_text("會議".encode("big5"), "big5") == "會議"
    assert to_text("é".encode(), "latin-1") == "é" and to_text(b"\xe9", "latin-1") == "é"
    assert to_text(b"\xff\xfe\xff", None) == "\ufffd\ufffd\ufffd" and to_text(b"", None) == "" and to_text(b"plain", "no such") == "plain"


@pytest.mark.parametrize("declared", [None, "us-ascii", "gb2312", "utf-8", "x-unknown"])
def test_undeclared_charsets_are_told_by_their_bytes(model, declared):
    for sentence in SENTENCES:
        text = sentence.replace("um acht", "um neun").replace("été", "hiver")
        for charset in model.charsets:
            assert to_text(text.encode(charset, "replace"), declared, model) == text.encode(charset, "replace").decode(charset)


def test_what_the_model_does_not_know_is_left_to_the_declaration(model):
    chinese = "关于下周三下午三点在会议室召开项目评审会议的通知，请各位同事准时参加。"
    assert to_text(chinese.encode("gbk"), "gb2312", model) == chinese
    assert to_text(chinese.encode("gb18030"), None, model) == chinese


def test_decoded_column(spark, model):
    rows = spark.createDataFrame([(1, SENTENCES[0].encode("cp850"), None, "x"), (2, None, "utf-8", "y"), (3, b"", None, "z")],
                                 "id long, data binary, declared string, text string")
    assert [tuple(r) for r in decoded(rows, "data", "declared", model).orderBy("id").collect()] == [
        (1, SENTENCES[0], None, "x"), (2, None, "utf-8", "y"), (3, "", None, "z")]


def test_model_without_texts(spark):
    empty = learn_charsets(spark.createDataFrame([], "text string"))
    assert isinstance(empty, Bigrams) and to_text(SENTENCES[1].encode(), None, empty) == SENTENCES[1]


def test_encoded_words():
    b = lambda t, c="utf-8": base64.b64encode(t.encode(c)).decode()
    assert header_text(f"=?utf-8?B?{b('会议')}?= =?UTF-8?b?{b('通知')}?=") == "会议通知"
    assert header_text(f"Re: =?gb2312?B?{b('鎔基', 'gbk')}?= soon") == "Re: 鎔基 soon"
    assert header_text("=?iso-8859-1?Q?caf=E9_cr=E8me?= bar") == "café crème bar"
    raw = "通知".encode()
    cut = [base64.b64encode(part).decode() for part in (raw[:4], raw[4:])]  # a character in two words
    assert header_text(f"=?utf-8?B?{cut[0]}?=\r\n =?utf-8?B?{cut[1]}?=") == "通知"
    assert header_text("=?utf-8*en?Q?x?= a_b =?no") == "x a_b =?no" and header_text(None) == "" and header_text("") == ""
    assert header_text("bare 通知 here") == "bare 通知 here" and header_text(r"C:\u1234 =?utf-8?Q?x?=") == r"C:\u1234 x"
    assert header_text(b"caf\xc3\xa9".decode("ascii", "surrogateescape")) == "café"


def test_mailboxes():
    assert mailboxes('"Doe, \\"J\\"" <A@X.org>, b@y.org (Bob; B), plain words') == [
        Mailbox("a@x.org", 'Doe, "J"'), Mailbox("b@y.org", "Bob; B")]
    assert [m.address for m in mailboxes("Team: c@z, D <d@w>; e@v")] == ["c@z", "d@w", "e@v"]
    assert mailboxes('"me@x.org" <none>') == [Mailbox("me@x.org", "")] and mailboxes(None) == mailboxes("not an address") == []
    assert mailboxes("=?utf-8?B?5byg5LiJ?= <q@r>") == [Mailbox("q@r", "张三")]
    assert len(mailboxes(",".join(f"N{k} <n{k}@x>" for k in range(5000)))) == 5000


def test_a_message_with_bare_bytes(model):
    raw = b"From: Jos\xc3\xa9 <J@x.org>\r\nSubject: caf\xc3\xa9\r\n =?utf-8?Q?=E2=82=AC?=\r\n\r\n" + SENTENCES[2].encode("mac-roman")
    got = take_apart(raw, model)
    assert (got["from_addr"], got["from_name"], got["subject"], got["plain"]) == ("j@x.org", "José", "café €", SENTENCES[2])
