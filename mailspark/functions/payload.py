"""Calendar payloads: building, canonical form, hash, difference."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import fold_spaces, iso_utc, let, local_day, nonempty, strip

OWNER_KEY = "event_owner_key"

_TIME = "struct<date:string,dateTime:string,timeZone:string>"
PAYLOAD = (f"struct<summary:string,description:string,location:string,start:{_TIME},end:{_TIME},status:string,"
           "transparency:string,extendedProperties:struct<private:map<string,string>>>")
CANONICAL = ("description", "end", "location", "owner", "start", "status", "summary", "transparency")


def parse_payload(text: Column) -> Column:
    return F.from_json(text, PAYLOAD)


def owner_of(payload: Column, key: str = OWNER_KEY) -> Column:
    """The ownership mark of a payload, null when it is not ours."""
    return nonempty(F.try_element_at(payload["extendedProperties"]["private"], F.lit(key)))


def normalize_stamp(text: Column) -> Column:
    """ISO text to the UTC minute; a stamp without a zone stays literal; unreadable text loses its seconds."""
    def form(t: Column) -> Column:
        zoned = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
        naive = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")
        parsed = F.date_format(F.try_to_timestamp(t), "yyyy-MM-dd'T'HH:mm")
        return F.when(zoned | naive, parsed).otherwise(F.regexp_replace(t, r":\d{2}(\.\d+)?$", ""))

    return let(strip(F.coalesce(text, F.lit(""))), form)


def normalize_time(field: Column) -> Column:
    """A payload time field: D:date for all-day, else the UTC minute."""
    return (F.when(F.length(field["date"]) > 0, F.concat(F.lit("D:"), F.substring(field["date"], 1, 10)))
            .when(F.length(field["dateTime"]) > 0, normalize_stamp(field["dateTime"]))
            .when(field.isNotNull(), F.lit("")))


def normalize_text(value: Column) -> Column:
    return fold_spaces(value)


def canonical(payload: Column, key: str = OWNER_KEY) -> Column:
    """The compared fields only, as a struct in name order; absent fields are null."""
    return F.struct(
        normalize_text(payload["description"]).alias("description"), normalize_time(payload["end"]).alias("end"),
        normalize_text(payload["location"]).alias("location"), owner_of(payload, key).alias("owner"),
        normalize_time(payload["start"]).alias("start"), normalize_text(payload["status"]).alias("status"),
        normalize_text(payload["summary"]).alias("summary"),
        normalize_text(payload["transparency"]).alias("transparency"))


def canonical_json(form: Column) -> Column:
    """Sorted-key JSON without the absent fields: what the hash is taken over."""
    return F.to_json(form)


def canonical_hash(form: Column) -> Column:
    return F.substring(F.sha2(canonical_json(form), 256), 1, 32)


def diff(mine: Column, theirs: Column) -> Column:
    """Differing canonical fields with both values, in name order."""
    def entry(name: str) -> Column:
        left, right = mine[name], theirs[name]
        return F.when(~left.eqNullSafe(right), F.struct(
            F.lit(name).alias("field"), left.alias("mine"), right.alias("theirs")))

    return F.filter(F.array(*[entry(n) for n in CANONICAL]), lambda d: d.isNotNull())


def describe(reason: Column, differences: Column) -> Column:
    """The verdict's reason, its first four differences and how many more there are."""
    def quoted(value: Column) -> Column:
        return F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None"))

    shown = F.transform(F.slice(differences, 1, 4), lambda d: F.concat(
        d["field"], F.lit(": 我方="), quoted(d["mine"]), F.lit(" → 远端="), quoted(d["theirs"])))
    more = F.size(differences) - 4
    tail = F.when(more > 0, F.concat(F.lit("（另有 "), more.cast("string"), F.lit(" 个字段不同）"))).otherwise(F.lit(""))
    text = F.concat(reason, F.lit("；差异："), F.array_join(shown, "；"), tail)
    return F.when(F.size(differences) > 0, text).otherwise(reason)


def all_day_dates(start_ts: Column, end_ts: Column, tz: str) -> tuple[Column, Column]:
    """Local first day and exclusive end day; the end lies at least one day after the start."""
    first = F.coalesce(local_day(start_ts, tz), F.lit("1970-01-01").cast("date"))
    last = F.coalesce(local_day(end_ts, tz), F.date_add(first, 1))
    return first, F.greatest(last, F.date_add(first, 1))


def build_payload(title: Column, start_ts: Column, end_ts: Column, all_day: Column, owner: Column, location: Column,
                  description: Column, tz: str, key: str = OWNER_KEY) -> Column:
    """An event row as a payload struct, ready for to_json."""
    first, last = all_day_dates(start_ts, end_ts, tz)
    none = F.lit(None).cast("string")

    def at(day: Column, ts: Column) -> Column:
        stamp = F.coalesce(iso_utc(ts), F.lit("1970-01-01T00:00:00Z"))
        return F.when(all_day, F.struct(day.cast("string").alias("date"), none.alias("dateTime"), none.alias("timeZone"))
                      ).otherwise(F.struct(none.alias("date"), stamp.alias("dateTime"), F.lit(tz).alias("timeZone")))

    return F.struct(
        F.coalesce(nonempty(title), F.lit(lx.NO_TITLE)).alias("summary"), nonempty(description).alias("description"),
        nonempty(location).alias("location"), at(first, start_ts).alias("start"),
        at(last, F.coalesce(end_ts, start_ts)).alias("end"), none.alias("status"), none.alias("transparency"),
        F.struct(F.create_map(F.lit(key), owner).alias("private")).alias("extendedProperties"))


def stable_description(snapshot: Column, evidence: Column, source: Column) -> Column:
    """The description last written, else one built from evidence and source."""
    built = F.concat_ws("\n", F.concat(F.lit("来源："), nonempty(evidence)),
                        F.concat(F.lit("自动创建（"), source, F.lit("）")))
    return F.coalesce(nonempty(F.get_json_object(snapshot, "$.description")), built)
