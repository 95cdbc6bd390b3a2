"""Column roles of an order-line table.

Operators take column names from a ``SalesSpec`` instead of hard-coding them,
so the same plans run on any flat order-line table (the driver star schema
flattened by ``sources.tables.sales_fact`` or a CSV export read by
``sources.csv.read_sales``).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SalesSpec:
    row_id: str = "row_id"
    order_id: str = "order_id"
    order_date: str = "order_date"
    ship_date: str = "ship_date"
    ship_mode: str = "ship_mode"
    customer_id: str = "customer_id"
    customer_name: str = "customer_name"
    segment: str = "segment"
    region: str = "region"
    state: str = "state"
    product_id: str = "product_id"
    product_name: str = "product_name"
    category: str = "category"
    sub_category: str = "sub_category"
    sales: str = "sales"
    quantity: str = "quantity"
    discount: str = "discount"
    profit: str = "profit"
    # Measures that are IQR-capped by the cleaning step.
    capped: tuple[str, ...] = ("sales", "profit", "quantity", "discount")
    # Identifier and free-text columns: never model features, imputed by mode.
    identifiers: tuple[str, ...] = field(default=(
        "row_id", "order_id", "customer_id", "customer_name", "product_id",
        "product_name"))

    @property
    def dates(self) -> tuple[str, str]:
        return (self.order_date, self.ship_date)

    def model_categoricals(self) -> tuple[str, ...]:
        """Text columns with a bounded vocabulary: one-hot features."""
        return (self.ship_mode, self.segment, self.region, self.state, self.category,
                self.sub_category)

    def model_exclusions(self) -> tuple[str, ...]:
        """Columns never used as features of the row-level sales model."""
        return (self.sales, self.profit, self.order_id, self.order_date,
                self.ship_date, self.customer_id, self.customer_name,
                self.product_id, self.product_name, self.row_id)


DEFAULT_SPEC = SalesSpec()
