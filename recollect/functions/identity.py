"""Deterministic ids. Missing parts are written as ``None``, as ids made elsewhere have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("None"))


def entity_pk(kind: Column | str, key: Column | str) -> Column:
    return F.md5(F.concat(F.lower(text_of(kind)), F.lit("-"), text_of(key)))


def triplet_id(actor_pk: Column | str, label: Column | str, object_pk: Column | str) -> Column:
    return F.md5(F.concat(text_of(actor_pk), F.lit("-"), text_of(label), F.lit("-"), text_of(object_pk)))


def version_id(pk: Column | str, data_hash: Column | str) -> Column:
    return F.md5(F.concat(text_of(pk), F.lit("-"), text_of(data_hash)))


def version_key(pk: Column | str, data_hash: Column | str) -> Column:
    """What versions are joined by: 16 bytes for the two texts, so that less is shuffled; null if one is null."""
    pk, data_hash = (F.col(c) if isinstance(c, str) else c for c in (pk, data_hash))
    return F.when(pk.isNotNull() & data_hash.isNotNull(), F.unhex(F.md5(F.concat(pk, F.lit("\x1f"), data_hash))))


def property_id(observer_pk: Column | str, pk: Column | str, kind: Column | str, value: Column | str) -> Column:
    """Without the property's name, as defined; keys of history rows add the name."""
    return F.md5(F.concat_ws("-", text_of(observer_pk), text_of(pk), text_of(kind), text_of(value)))


def traits_hash(traits: Column | str) -> Column:
    """Of a map of flattened traits, whatever its order."""
    pairs = F.transform(F.array_sort(F.map_entries(traits)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return F.md5(F.array_join(pairs, "\x1f"))


def session_slot(ts: Column | str, key: Column | str, minutes: int = 15) -> Column:
    """An id for the quarter of an hour in which something without a session came."""
    return F.md5(F.concat(text_of(key), F.lit("-"), F.floor(F.unix_timestamp(ts) / (60 * minutes)).cast("string")))


#: The trait that names an extracted entity of a kind, and the traits that identify one everywhere.
ID_TRAITS = {"topic": "$type", "aspect": "$type", "device": "$serial_number", "place": "$address", "location": "$address", "country": "$name"}
IDENTIFYING_TRAITS = {"person": ("$email",), "organization": ("$email",), "document": ("$type", "$number"), "location": ("$label",), "country": ("$label",), "aspect": ("$type",)}


def extracted_kind(kind: Column | str) -> Column:
    """Lower case, without spaces."""
    return F.lower(F.trim(F.replace(F.col(kind) if isinstance(kind, str) else kind, F.lit(" "), F.lit(""))))


def extracted_id(kind: Column | str, traits: Column | str) -> Column:
    """The id of an entity that was found in a text: by the trait that names its kind, else by ``$id``, else a random one."""
    own, held = extracted_kind(kind), F.col(traits) if isinstance(traits, str) else traits
    named = F.coalesce(*[F.when(own == k, F.nullif(F.try_element_at(held, F.lit(t)), F.lit(""))) for k, t in ID_TRAITS.items()])
    return F.md5(F.concat_ws("-", own, F.coalesce(named, F.try_element_at(held, F.lit("$id")), F.uuid())))
