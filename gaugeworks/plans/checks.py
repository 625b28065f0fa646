"""Declarative policy checks over the resources of a plan.

A check maps ``(resource, resources)`` to a condition on one resource. A body holds if some
resource passes all its checks, a rule if one of its bodies holds, and rules combine to further
rules. Everything becomes one Catalyst expression over the plan's row: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import variants
from gaugeworks.plans import documents

Check = Callable[[Column, Column], Column]
Rule = Callable[[Column], Column]

# Shape of an IPv4 block, and of the prefix length and one group of an IPv6 block.
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_CIDR = rf"^{_OCTET}(\.{_OCTET}){{3}}/(3[0-2]|[12]?\d)$"
IPV6_PREFIX = r"^(12[0-8]|1[01]\d|[1-9]?\d)$"
IPV6_GROUP = r"^[0-9A-Fa-f]{1,4}$"


def ipv4_cidr(text: Column) -> Column:
    return text.rlike(IPV4_CIDR)


def ipv6_cidr(text: Column) -> Column:
    """Eight groups, or fewer around one ``::``."""
    parts = F.split(text, "/")
    address, prefix = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    groups = F.split(address, ":")
    filled = F.filter(groups, lambda g: g != "")
    short = F.contains(address, F.lit("::"))
    single_ends = address.rlike("^:[^:]") | address.rlike("[^:]:$")
    once = F.size(F.split(address, "::")) == 2
    return (
        (F.size(parts) == 2)
        & prefix.rlike(IPV6_PREFIX)
        & F.forall(filled, lambda g: g.rlike(IPV6_GROUP))
        & ~single_ends
        & ~F.contains(address, F.lit(":::"))
        & F.when(short, once & (F.size(filled) <= 7)).otherwise(
            (F.size(groups) == 8) & (F.size(filled) == 8)
        )
    )


class Section:
    """Checks on the attributes of one plan section.

    In ``configuration`` an attribute wraps its value as ``constant_value``; in the other
    sections it is the value.
    """

    def __init__(self, name: str = "configuration"):
        if name not in documents.SECTIONS:
            raise ValueError(f"unknown section: {name}")
        self.name = name
        self._constant = ".constant_value" if name == "configuration" else ""

    def _attribute(self, resource: Column, path: str, type_: str = "variant") -> Column:
        return F.try_variant_get(resource["attributes"], f"$.{path}", type_)

    def _value(self, resource: Column, path: str, type_: str = "variant") -> Column:
        return self._attribute(resource, path + self._constant, type_)

    def has_type(self, type_: str) -> Check:
        return lambda r, _: r["type"] == type_

    def has_mode(self, mode: str) -> Check:
        return lambda r, _: r["mode"] == mode

    def defined(self, path: str) -> Check:
        """The attribute is present and not false."""

        def check(r: Column, _: Column) -> Column:
            node = self._attribute(r, path)
            return node.isNotNull() & ~variants.is_false(node, zero_is_false=False)

        return check

    def undefined(self, path: str) -> Check:
        """The negation of ``defined``: missing, or false."""
        defined = self.defined(path)
        return lambda r, rs: ~F.coalesce(defined(r, rs), F.lit(False))

    def equals(self, path: str, value: str | int | float | bool) -> Check:
        """Typed constant equality; it does not hold for a missing value or another type."""

        def check(r: Column, _: Column) -> Column:
            return self._same_kind(r, path, value) & (self._typed(r, path, value) == F.lit(value))

        return check

    def differs(self, path: str, value: str | int | float | bool) -> Check:
        """The value is there and is not this one."""

        def check(r: Column, _: Column) -> Column:
            same = F.coalesce(
                self._same_kind(r, path, value) & (self._typed(r, path, value) == F.lit(value)), F.lit(False)
            )
            return self._value(r, path).isNotNull() & ~same

        return check

    def not_null(self, path: str) -> Check:
        """Present and not a JSON null."""

        def check(r: Column, _: Column) -> Column:
            node = self._value(r, path)
            return node.isNotNull() & ~F.is_variant_null(node)

        return check

    def is_boolean(self, path: str) -> Check:
        return lambda r, _: variants.type_name(self._value(r, path)) == "BOOLEAN"

    def in_range(self, path: str, low: float, high: float) -> Check:
        """A number in the range; texts and booleans are in none."""
        return lambda r, _: self._same_kind(r, path, low) & self._value(r, path, "double").between(low, high)

    def is_cidr(self, path: str, version: int | None = None) -> Check:
        shapes = {4: [ipv4_cidr], 6: [ipv6_cidr], None: [ipv4_cidr, ipv6_cidr]}[version]

        def check(r: Column, _: Column) -> Column:
            value = self._value(r, path, "string")
            return reduce(or_, [shape(value) for shape in shapes])

        return check

    def one_of(self, path: str, values: Sequence[str]) -> Check:
        return lambda r, _: self._same_kind(r, path, "") & self._value(r, path, "string").isin(*values)

    def without(self, path: str, *others: str) -> Check:
        """The attribute is defined and the conflicting ones are not."""
        return all_of(self.defined(path), *[self.undefined(other) for other in others])

    def text_below(self, path: str, bound: str) -> Check:
        """Lexicographic comparison, as versions are compared."""
        return lambda r, _: self._same_kind(r, path, bound) & (self._value(r, path, "string") < bound)

    def text_at_least(self, path: str, bound: str) -> Check:
        return lambda r, _: self._same_kind(r, path, bound) & (self._value(r, path, "string") >= bound)

    def refers_to(self, path: str, type_: str, *checks: Check) -> Check:
        """The attribute refers to a resource of the type, in the same plan, passing the checks."""

        def check(r: Column, resources: Column) -> Column:
            references = self._attribute(r, path + ".references", "array<string>")
            passing = F.filter(resources, lambda b: _holds([self.has_type(type_), *checks], b, resources))
            return F.arrays_overlap(references, F.transform(passing, lambda b: b["address"]))

        return check

    def _typed(self, resource: Column, path: str, value) -> Column:
        type_ = {bool: "boolean", str: "string"}.get(type(value), "double")
        return self._value(resource, path, type_)

    def _same_kind(self, resource: Column, path: str, value) -> Column:
        kind = variants.type_name(self._value(resource, path))
        if isinstance(value, bool):
            return kind == "BOOLEAN"
        if isinstance(value, str):
            return kind == "STRING"
        return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def all_of(*checks: Check) -> Check:
    return lambda r, rs: reduce(and_, [c(r, rs) for c in checks])


def any_of(*checks: Check) -> Check:
    return lambda r, rs: reduce(or_, [F.coalesce(c(r, rs), F.lit(False)) for c in checks])


def _holds(checks: Sequence[Check], resource: Column, resources: Column) -> Column:
    return F.coalesce(all_of(*checks)(resource, resources), F.lit(False))


def body(*checks: Check) -> Rule:
    """Some resource passes all checks."""
    return lambda rs: F.exists(rs, lambda r: _holds(checks, r, rs))


def at_least(count: int, *checks: Check) -> Rule:
    """At least that many resources pass all checks."""
    return lambda rs: F.size(F.filter(rs, lambda r: _holds(checks, r, rs))) >= count


def either(*rules: Rule) -> Rule:
    return lambda rs: reduce(or_, [r(rs) for r in rules])


def every(*rules: Rule) -> Rule:
    return lambda rs: reduce(and_, [r(rs) for r in rules])


def evaluate(
    plans: DataFrame, rules: Mapping[str, Rule], section: str = "configuration", key: str = "plan_id"
) -> DataFrame:
    """One boolean column per rule, false by default, for every plan."""
    rows = plans.select(key, documents.resource_array(F.col("doc"), section).alias("_resources"))
    return rows.select(
        key, *[F.coalesce(rule(F.col("_resources")), F.lit(False)).alias(name) for name, rule in rules.items()]
    )
