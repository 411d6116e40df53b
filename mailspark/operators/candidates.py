"""Candidates of all sources brought together: calendar parts, rules, model responses; merged and cross-checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import casefold, local_day, local_time, nonempty, strip
from mailspark.functions.fingerprint import event_fingerprint
from mailspark.operators.prefilter import classify
from mailspark.operators.rules import DEFAULT_MINUTES, DEFAULT_ZONE, rule_candidates, rule_hits
from mailspark.session import by_key, checkpointed

JOINER = "；"


def ics_candidates(vevents: DataFrame, now: Column, known_contact: str | None = "is_known_contact",
                   non_contact_auto_push: bool = False, tz: str | None = None) -> DataFrame:
    """Gate calendar entries: reasons accumulate, and none of them means that the entry may go out by itself."""
    method = F.upper(F.coalesce(F.col("method"), F.lit("REQUEST")))
    contact = F.coalesce(F.col(known_contact), F.lit(False)) if known_contact else F.lit(True)
    before, after = lx.ICS_NOT_REQUEST
    reasons = F.filter(F.array(
        F.when(F.col("is_cancellation"), F.lit(lx.ICS_CANCEL)),
        F.when(method != "REQUEST", F.concat(F.lit(before), F.col("method"), F.lit(after))),
        F.when(F.coalesce(F.length("organizer"), F.lit(0)) == 0, F.lit(lx.ICS_NO_ORGANIZER)),
        F.when(F.col("start_ts").isNull(), F.lit(lx.ICS_NO_START)),
        F.when(~contact & F.lit(not non_contact_auto_push), F.lit(lx.ICS_NOT_CONTACT)),
        F.when(F.col("start_ts") < now, F.lit(lx.GATE_PAST)),
        F.when(method == "REPLY", F.lit(lx.ICS_REPLY))
        .when(F.col("start_ts").isNull(), F.lit(lx.ICS_MISSING_DTSTART)),
    ), lambda r: r.isNotNull())
    gated = vevents.withColumn("review_reason", F.array_join(reasons, JOINER))
    review = F.col("review_reason") != ""
    return gated.select(
        "message_id", F.col("ord").cast("int").alias("ord"), F.col("summary").alias("title"), "start_ts", "end_ts",
        "all_day", F.lit("ics").alias("source"), F.when(review, 0.9).otherwise(0.99).alias("confidence"),
        "fingerprint", "evidence", "location", "organizer", F.lit(tz).cast("string").alias("tz"),
        F.col("uid").alias("ics_uid"), F.col("sequence").alias("ics_sequence"),
        F.col("recurrence_id").alias("ics_recurrence_id"), F.col("rrule").alias("ics_rrule"),
        review.alias("requires_review"), "review_reason", F.lit(False).alias("title_from_subject"))


_LLM_SCHEMA = ("struct<events:array<struct<title:string,start:string,end:string,all_day:boolean,location:string,"
               "confidence:double,evidence:string>>,todos:array<string>>")


def llm_json(response: Column) -> Column:
    """The JSON object inside a model response: fenced, bare, or embedded in other text; null when there is none."""
    text = strip(F.coalesce(response, F.lit("")))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)```", 1)
    body = strip(F.when(F.length(fenced) > 0, fenced).otherwise(text))
    embedded = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), nonempty(body)).otherwise(nonempty(embedded))


def llm_candidates(responses: DataFrame, tz: str = DEFAULT_ZONE, minutes: int = DEFAULT_MINUTES) -> DataFrame:
    """Model responses (message_id, response) to candidates. Events without a readable start are dropped, and
    whatever the model claims, a person has to confirm it."""
    parsed = responses.select("message_id", F.from_json(llm_json(F.col("response")), _LLM_SCHEMA).alias("answer"))
    # one event out of range makes the whole answer unusable, as a schema check would
    usable = parsed.where(~F.exists(F.coalesce(F.col("answer.events"), F.expr("array()")),
                                    lambda e: F.coalesce(~e["confidence"].between(0.0, 1.0), F.lit(False))))
    rows = usable.select("message_id", F.posexplode("answer.events").alias("ord", "e"))
    all_day = F.coalesce(F.col("e.all_day"), F.lit(False))
    rows = (rows
            .withColumn("start_ts", _model_time(F.col("e.start"), tz)).where(F.col("start_ts").isNotNull())
            .withColumn("end_ts", F.coalesce(
                _model_time(F.col("e.end"), tz),
                F.when(~all_day, F.col("start_ts") + F.make_dt_interval(mins=F.lit(minutes))))))
    text = F.lit(None).cast("string")
    return rows.select(
        "message_id", F.col("ord").cast("int").alias("ord"),
        F.coalesce(nonempty(F.col("e.title")), F.lit(lx.NO_TITLE)).alias("title"), "start_ts", "end_ts",
        all_day.alias("all_day"), F.lit("llm").alias("source"),
        F.coalesce(F.col("e.confidence"), F.lit(0.5)).alias("confidence"),
        event_fingerprint(F.col("e.title"), F.col("start_ts"), F.col("end_ts"), text, F.col("e.location"))
        .alias("fingerprint"),
        F.coalesce(F.col("e.evidence"), F.lit("")).alias("evidence"), F.col("e.location").alias("location"),
        text.alias("organizer"), text.alias("tz"), text.alias("ics_uid"),
        F.lit(None).cast("int").alias("ics_sequence"), text.alias("ics_recurrence_id"), text.alias("ics_rrule"),
        F.lit(True).alias("requires_review"), F.lit(lx.GATE_LLM).alias("review_reason"),
        F.lit(False).alias("title_from_subject"))


def _model_time(value: Column, tz: str) -> Column:
    """ISO text; a stamp without a zone is local, and a broken stamp falls back to its date."""
    text = strip(value)
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]")
    day = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    local = F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text)), day)
    return F.when(zoned, F.coalesce(F.try_to_timestamp(text), F.to_utc_timestamp(day, tz))).otherwise(
        F.to_utc_timestamp(local, tz))


def combine(ics: DataFrame | None, rules: DataFrame, llm: DataFrame | None) -> DataFrame:
    """All candidates in source order. Hits at an instant that a calendar part already covers are left out."""
    minute = F.date_trunc("minute", F.col("start_ts"))
    parts = []
    if ics is not None:
        covered = ics.where(F.col("start_ts").isNotNull()).select("message_id", minute.alias("_minute")).distinct()

        def uncovered(df: DataFrame) -> DataFrame:
            return df.withColumn("_minute", minute).join(by_key(covered), ["message_id", "_minute"], "left_anti").drop("_minute")

        parts.append(ics)
        rules = uncovered(rules)
        llm = uncovered(llm) if llm is not None else None
    parts.append(rules)
    if llm is not None:
        parts.append(llm)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _order() -> Column:
    rank = F.create_map(*[x for s, p in lx.SOURCE_PRIORITY.items() for x in (F.lit(s), F.lit(-p))])
    return F.struct(rank[F.col("source")].alias("rank"), F.col("ord").alias("ord"))


def dedupe_slots(candidates: DataFrame, tz: str = DEFAULT_ZONE) -> DataFrame:
    """One candidate per message and time slot.

    The most trusted source keeps the slot; what it displaces leaves a note in the evidence, may lend a better
    title, and keeps its demand for review. An all-day candidate gives way to timed ones of the same local day.
    A group is one slot of one message, all of it derived from that message's own row.
    """
    keyed = (candidates.repartition("message_id")
             .withColumn("_o", _order())
             .withColumn("_day", local_day(F.col("start_ts"), tz))
             .withColumn("_timed", F.col("_day").isNotNull() & ~F.col("all_day")))
    day = Window.partitionBy("message_id", "_day")
    note = F.concat(F.lit("另有 "), F.col("source"), F.lit(" 给出同日全天："), F.col("title"))
    noted = (
        keyed
        .withColumn("_day_timed", F.col("_day").isNotNull() & F.max("_timed").over(day))
        .withColumn("_notes", F.array_sort(F.collect_list(
            F.when(~F.col("_timed") & F.col("_day").isNotNull(), F.struct(F.col("_o").alias("o"), note.alias("note")))).over(day)))
        .where(F.col("_timed") | ~F.col("_day_timed"))
        .withColumn("evidence", F.when(F.col("_timed"), _append(
            F.col("evidence"), F.transform(F.col("_notes"), lambda n: n["note"]))).otherwise(F.col("evidence"))))
    slot = (F.when(F.col("_day").isNull(), F.concat(F.lit("none:"), F.coalesce("fingerprint", F.lit(""))))
            .when(F.col("all_day"), F.concat(F.col("_day").cast("string"), F.lit(":allday")))
            .otherwise(F.concat(F.col("_day").cast("string"), F.lit(":"),
                                F.date_format(local_time(F.col("start_ts"), tz), "HH:mm"))))
    payload = [c for c in candidates.columns if c != "message_id"]
    grouped = (noted.withColumn("_slot", slot)
               .groupBy("message_id", "_slot")
               .agg(F.array_sort(F.collect_list(F.struct("_o", *payload))).alias("members")))
    winner = F.get(F.col("members"), F.lit(0))
    merged = grouped.withColumn("_w", F.aggregate(
        F.slice("members", F.lit(2), F.greatest(F.size("members"), F.lit(1))),
        F.struct(winner["title"].alias("title"), winner["evidence"].alias("evidence"),
                 winner["requires_review"].alias("review"), winner["review_reason"].alias("reason")),
        lambda acc, m: _absorb(acc, m, winner["title_from_subject"])))
    replaced = {"title": F.col("_w.title"), "evidence": F.col("_w.evidence"),
                "requires_review": F.col("_w.review"), "review_reason": F.col("_w.reason")}
    return merged.select("message_id", *[replaced.get(c, winner[c]).alias(c) for c in payload])


def _append(evidence: Column, notes: Column) -> Column:
    own = F.filter(F.array(nonempty(evidence)), lambda e: e.isNotNull())
    return F.array_join(F.concat(own, notes), JOINER)


def _absorb(acc: Column, loser: Column, generic: Column) -> Column:
    """Merge one displaced candidate into the kept one."""
    lost = F.coalesce(loser["title"], F.lit(""))
    differs = (lost != "") & (casefold(lost) != casefold(F.coalesce(acc["title"], F.lit(""))))
    lends = differs & generic & ~loser["title_from_subject"]
    note = F.concat(F.lit("另有 "), loser["source"], F.lit(" 给出："), lost)
    adds_review = loser["requires_review"] & ~acc["review"]
    return F.struct(
        F.when(lends, lost).otherwise(acc["title"]).alias("title"),
        F.when(differs & ~lends, _append(acc["evidence"], F.array(note))).otherwise(acc["evidence"]).alias("evidence"),
        (acc["review"] | loser["requires_review"]).alias("review"),
        F.when(adds_review, F.concat_ws(JOINER, nonempty(acc["reason"]), loser["review_reason"]))
        .otherwise(acc["reason"]).alias("reason"))


def mark_conflicts(candidates: DataFrame, tz: str = DEFAULT_ZONE, minutes: int = lx.CONFLICT_MINUTES) -> DataFrame:
    """Timed candidates of one message and local day that lie too far apart list each other and need review.

    Expects slot-deduplicated rows, which bounds a (message, day) group by the minutes of a day.
    """
    # local days are compared; comparing UTC days would split one local day in two
    keyed = (candidates.withColumn("_day", local_day(F.col("start_ts"), tz))
             .withColumn("_min", (F.unix_timestamp("start_ts") / 60).cast("long")).withColumn("_o", _order()))
    day = Window.partitionBy("message_id", "_day")
    others = F.array_sort(F.collect_list(F.when(F.col("_day").isNotNull(), F.struct(
        F.col("_o").alias("o"), F.col("_min").alias("m"), F.col("fingerprint").alias("fp")))).over(day))
    listed = keyed.withColumn("_all", others).withColumn("conflicts_with", F.transform(
        F.filter("_all", lambda x: F.abs(x["m"] - F.col("_min")) > minutes), lambda x: x["fp"]))
    has = F.size("conflicts_with") > 0
    return (listed
            .withColumn("requires_review", F.col("requires_review") | has)
            .withColumn("review_reason", F.when(has, F.concat_ws(
                JOINER, nonempty(F.col("review_reason")), F.lit(lx.CONFLICT_REASON))).otherwise(F.col("review_reason")))
            .drop("_day", "_min", "_o", "_all"))


def extract(messages: DataFrame, now: Column, vevents: DataFrame | None = None,
            llm_responses: DataFrame | None = None, contacts: DataFrame | None = None, tz: str = DEFAULT_ZONE,
            minutes: int = DEFAULT_MINUTES, threshold: float = lx.AUTO_PUSH_THRESHOLD,
            ambiguous_policy: str = "pending", non_contact_auto_push: bool = False) -> tuple[DataFrame, DataFrame]:
    """Messages to (verdicts, candidates): prefilter, three sources of falling trust, merge, cross-check.

    ``messages``: message_id, subject, text, received_at, auto_submitted, is_list, has_ics, from_addr.
    ``contacts``: addresses the user has answered; None trusts every sender.
    """
    judged = classify(messages, text="text")
    verdicts = judged.select("message_id", "verdict.*")
    hits = rule_hits(judged.where("verdict.extract"), tz, minutes)
    rules = rule_candidates(hits, now, tz, threshold, ambiguous_policy)
    if vevents is not None or llm_responses is not None:
        # verdicts and rule hits are read again below: keep the thin results, not the passes over the texts
        verdicts, rules = checkpointed(verdicts), checkpointed(rules)
    ics = None
    if vevents is not None:
        senders = messages.select("message_id", F.lower("from_addr").alias("_from"))
        owned = vevents.join(by_key(verdicts.where("extract").select("message_id")), "message_id", "left_semi").join(
            by_key(senders), "message_id")
        if contacts is not None:
            known = contacts.select(F.lower("addr").alias("_from")).distinct().withColumn("is_known_contact", F.lit(True))
            owned = owned.join(known, "_from", "left")
        ics = ics_candidates(owned, now, "is_known_contact" if contacts is not None else None, non_contact_auto_push)
    llm = None
    if llm_responses is not None:
        settled = rules.where(~F.col("requires_review")).select("message_id").distinct()
        asked = verdicts.where("extract and call_llm").select("message_id").join(by_key(settled), "message_id", "left_anti")
        llm = llm_candidates(llm_responses.join(by_key(asked), "message_id", "left_semi"), tz, minutes)
    return verdicts, mark_conflicts(dedupe_slots(combine(ics, rules, llm), tz), tz)


def outcome_summary(candidates: DataFrame) -> DataFrame:
    """Per message: candidates, how many may go out, how many wait, and which sources spoke."""
    return candidates.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(~F.col("requires_review")).alias("auto_pushable"),
        F.count_if("requires_review").alias("requires_review"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
