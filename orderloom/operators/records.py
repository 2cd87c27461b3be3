"""What a valid customer, product and order record looks like."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Kind(Enum):
    """Value types of record fields and the Spark type each is loaded as."""

    TEXT = "string"
    MONEY = "decimal(10,2)"
    WHOLE = "int"
    MOMENT = "timestamp_ntz"


@dataclass(frozen=True)
class Field:
    name: str
    kind: Kind = Kind.TEXT
    required: bool = True
    min_length: int | None = None
    pattern: str | None = None
    one_of: tuple[str, ...] = ()
    above: int | None = None
    at_least: int | None = None
    lower: bool = False


@dataclass(frozen=True)
class Record:
    name: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]


# Word characters are Unicode and the end is the end of the text.
EMAIL = r"(?U)^[\w.-]+@[\w.-]+\.\w+\z"
# Order states.
STATUSES = ("pending", "completed", "shipped", "cancelled")

CUSTOMERS = Record(
    "customers",
    (
        Field("customer_id", min_length=1),
        Field("first_name", min_length=1),
        Field("last_name", min_length=1),
        Field("email", pattern=EMAIL, lower=True),
        Field("country", min_length=2),
        Field("created_at", Kind.MOMENT, required=False),
    ),
)
PRODUCTS = Record(
    "products",
    (
        Field("product_id", min_length=1),
        Field("product_name", min_length=1),
        Field("category", min_length=1),
        Field("price", Kind.MONEY, above=0),
        Field("cost", Kind.MONEY, at_least=0),
    ),
)
ORDERS = Record(
    "orders",
    (
        Field("order_id", min_length=1),
        Field("customer_id", min_length=1),
        Field("product_id", min_length=1),
        Field("quantity", Kind.WHOLE, above=0),
        Field("order_date", Kind.MOMENT, required=False),
        Field("status", one_of=STATUSES),
    ),
)

RECORDS = {record.name: record for record in (CUSTOMERS, PRODUCTS, ORDERS)}
