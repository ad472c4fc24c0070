"""The event ontology, and names as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions.text import let, squeeze_key, trim_ws

# Event types, their roles, and how visible a role is in images. Text and image roles are the same.
ROLES = {
    "Movement:Transport": {"Agent": "weak", "Artifact": "strong", "Vehicle": "strong", "Destination": "weak", "Origin": "weak"},
    "Conflict:Attack": {"Attacker": "weak", "Target": "strong", "Instrument": "strong", "Place": "strong"},
    "Conflict:Demonstrate": {"Entity": "strong", "Police": "weak", "Instrument": "strong", "Place": "strong"},
    "Justice:Arrest-Jail": {"Agent": "strong", "Person": "strong", "Instrument": "strong", "Place": "weak"},
    "Contact:Phone-Write": {"Entity": "weak", "Instrument": "strong", "Place": "weak"},
    "Contact:Meet": {"Participant": "strong", "Place": "weak"},
    "Life:Die": {"Victim": "strong", "Agent": "weak", "Instrument": "weak", "Place": "strong"},
    "Transaction:Transfer-Money": {"Giver": "weak", "Recipient": "weak", "Money": "strong"},
}
# Other names of event types and roles.
TYPE_ALIASES = {
    "Justice:ArrestJail": "Justice:Arrest-Jail",
    "Contact:PhoneWrite": "Contact:Phone-Write",
    "Transaction:TransferMoney": "Transaction:Transfer-Money",
    "Arrest": "Justice:Arrest-Jail",
    "Writing": "Contact:Phone-Write",
}
ROLE_ALIASES = {"Detainee": "Person", "Suspect": "Person"}
EVENT_ROLE_ALIASES = {"Contact:Meet": {"Entity": "Participant", "Participant": "Participant"}}
# Labels too general to place an event in an image (exact), and terms for the same in analysis (contained).
WEAK_PLACE_LABELS = ("street", "road", "outdoors", "outdoor", "outside", "scene", "background", "area", "crowd")
WEAK_PLACE_TERMS = ("area", "scene", "location", "place", "street", "road", "outside", "outdoor", "building", "site", "market area")


def _squeezed(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _quoted(value: str | list[str]) -> str:
    if isinstance(value, list):
        return f"array({', '.join(map(_quoted, value))})"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(pairs: dict) -> Column:
    """A map of texts to texts (or lists of them), as one expression."""
    return F.expr(f"map({', '.join(_quoted(x) for pair in pairs.items() for x in pair)})")


def _look_up(pairs: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(pairs), key) if pairs else F.lit(None).cast("string")


def is_supported(event_type: Column) -> Column:
    return event_type.isin(*ROLES)


def allowed_roles(event_type: Column) -> Column:
    """Roles of a type, none for other types."""
    return F.coalesce(F.try_element_at(literal_map({name: list(roles) for name, roles in ROLES.items()}), event_type), F.expr("cast(array() as array<string>)"))


#: All role names; none of them is another name of a role in every event.
ROLE_NAMES = tuple(sorted({r for roles in ROLES.values() for r in roles}))


def canonical_type(value: Column) -> Column:
    """An event type by its name, an alias, or either without punctuation and case; else as it is. Null is empty. A type's own name takes no pattern matching."""
    loose = {_squeezed(t): t for t in ROLES} | {_squeezed(a): t for a, t in TYPE_ALIASES.items()}
    return F.when(value.isNull(), "").when(is_supported(value), value).otherwise(let(trim_ws(F.coalesce(value, F.lit(""))), lambda raw: F.coalesce(_look_up(TYPE_ALIASES, raw), F.when(is_supported(raw), raw), _look_up(loose, squeeze_key(raw)), raw)))


def canonical_role(value: Column) -> Column:
    """A role by its name, an alias, or that without punctuation and case; else as it is. Null is empty."""
    loose = {_squeezed(a): r for a, r in ROLE_ALIASES.items()}
    return F.when(value.isin(*ROLE_NAMES), value).otherwise(let(trim_ws(F.coalesce(value, F.lit(""))), lambda raw: F.coalesce(_look_up(ROLE_ALIASES, raw), _look_up(loose, squeeze_key(raw)), raw)))


def plain_role(value: Column) -> Column:
    """A role as it is written, without white space at its ends; null is empty."""
    value = F.trim(value)  # spaces go without a pattern
    return F.when(value.isin(*ROLE_NAMES), value).otherwise(trim_ws(F.coalesce(value, F.lit(""))))


def canonical_role_for(event_type: Column, value: Column) -> Column:
    """A role by global aliases and then those of its (canonical) event type. Names that are spelled as they are known take a look-up and no pattern matching."""
    value = F.trim(value)
    loose = {_squeezed(a): r for a, r in ROLE_ALIASES.items()}
    spelled = {*ROLE_NAMES, *ROLE_ALIASES, *(a for aliases in EVENT_ROLE_ALIASES.values() for a in aliases)}
    plain = {name: ROLE_ALIASES.get(name) or loose.get(_squeezed(name)) or name for name in sorted(spelled)}
    known = F.when(~event_type.isin(*EVENT_ROLE_ALIASES), _look_up(plain, value))

    def own(role: Column) -> Column:
        out = role
        for name, aliases in EVENT_ROLE_ALIASES.items():
            near = {_squeezed(a): r for a, r in aliases.items()}
            out = F.when(event_type == name, F.coalesce(_look_up(aliases, role), _look_up(near, squeeze_key(role)), role)).otherwise(out)
        return out

    for name, aliases in EVENT_ROLE_ALIASES.items():
        near = {_squeezed(a): r for a, r in aliases.items()}
        known = known.when(event_type == name, _look_up({k: aliases.get(v) or near.get(_squeezed(v)) or v for k, v in plain.items()}, value))
    return F.coalesce(known, let(canonical_role(value), own))


def visibility(event_type: Column, role: Column) -> Column:
    """strong or weak; weak where nothing is known."""
    pairs = {f"{t}|{r}": v for t, roles in ROLES.items() for r, v in roles.items()}
    return F.coalesce(_look_up(pairs, F.concat_ws("|", event_type, role)), F.lit("weak"))


def event_roles(spark: SparkSession) -> DataFrame:
    """The dimension table (event_type, role, visibility)."""
    rows = [(t, r, v) for t, roles in ROLES.items() for r, v in roles.items()]
    return spark.createDataFrame(rows, "event_type string, role string, visibility string")


def is_weak_place_label(label: Column) -> Column:
    return F.lower(trim_ws(F.coalesce(label, F.lit("")))).isin(*WEAK_PLACE_LABELS)


def mentions_weak_place(label: Column) -> Column:
    return let(F.lower(trim_ws(F.coalesce(label, F.lit("")))), lambda value: reduce(Column.__or__, [value.contains(t) for t in WEAK_PLACE_TERMS]))
