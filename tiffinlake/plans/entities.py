"""One declarative spec per source entity: raw columns, typed columns, keys and dimension names."""

from __future__ import annotations

from dataclasses import dataclass, field

# Kinds of typed column. "decimal(p,s)" is a kind of its own and is passed to the cast as it is.
KEY, TEXT, TRIM, TS, DATE, YES_NO, BOOL = "key", "text", "trim", "timestamp", "date", "yes_no", "bool"


@dataclass(frozen=True)
class Field:
    name: str
    raw: str
    kind: str = TEXT
    tag: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    column: str
    entity: str
    ref_column: str


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...]
    keys: tuple[str, ...]
    modified: str
    surrogate: str | None = None
    tracking: tuple[str, ...] = ()
    update_columns: tuple[str, ...] | None = None
    required: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    raw_aliases: dict = field(default_factory=dict, hash=False)
    # Creation time of a table that grows with sales and is stored by month; None for master data.
    created: str | None = None
    start: str = "eff_start_date"
    end: str = "eff_end_date"
    flag: str = "is_current"

    @property
    def raw_columns(self) -> list[str]:
        """Raw columns in file order."""
        return [f.raw for f in self.fields]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def tags(self) -> dict[str, str]:
        return {f.name: f.tag for f in self.fields if f.tag}


LOCATION = Entity(
    name="location",
    fields=(
        Field("location_id", "locationid", KEY),
        Field("city", "city"),
        Field("state", "state"),
        Field("zip_code", "zipcode"),
        Field("active_flag", "activeflag", YES_NO),
        Field("created_ts", "createddate", TS),
        Field("modified_ts", "modifieddate", TS),
    ),
    keys=("location_id",),
    modified="modified_ts",
    surrogate="restaurant_location_hk",
    tracking=(
        "city", "state", "state_code", "is_union_territory", "capital_city_flag", "city_tier",
        "zip_code", "active_flag",
    ),
    required=("location_id", "city", "state", "state_code", "zip_code", "active_flag", "created_ts"),
    raw_aliases={"createddate": "createdate"},
    start="eff_start_dt",
    end="eff_end_dt",
    flag="current_flag",
)

RESTAURANT = Entity(
    name="restaurant",
    fields=(
        Field("restaurant_id", "restaurantid", KEY),
        Field("name", "name"),
        Field("cuisine_type", "cuisinetype"),
        Field("pricing_for_two", "pricing_for_2", "decimal(10,2)"),
        Field("restaurant_phone", "restaurant_phone", tag="SENSITIVE"),
        Field("operating_hours", "operatinghours"),
        Field("location_id_fk", "locationid", KEY),
        Field("active_flag", "activeflag"),
        Field("open_status", "openstatus"),
        Field("locality", "locality"),
        Field("restaurant_address", "restaurant_address"),
        Field("latitude", "latitude", "decimal(9,6)"),
        Field("longitude", "longitude", "decimal(9,6)"),
        Field("created_dt", "createddate", TS),
        Field("modified_dt", "modifieddate", TS),
    ),
    keys=("restaurant_id",),
    modified="modified_dt",
    surrogate="restaurant_hk",
    tracking=(
        "name", "cuisine_type", "pricing_for_two", "restaurant_phone", "operating_hours",
        "location_id_fk", "active_flag", "open_status", "locality", "restaurant_address",
        "latitude", "longitude",
    ),
    required=("restaurant_id", "name"),
    foreign_keys=(ForeignKey("location_id_fk", "location", "location_id"),),
)

CUSTOMER = Entity(
    name="customer",
    fields=(
        Field("customer_id", "customerid", KEY),
        Field("name", "name"),
        Field("mobile", "mobile", tag="PII"),
        Field("email", "email", tag="EMAIL"),
        Field("login_by_using", "loginbyusing"),
        Field("gender", "gender", tag="PII"),
        Field("dob", "dob", DATE, tag="PII"),
        Field("anniversary", "anniversary", DATE),
        Field("preferences", "preferences"),
        Field("created_dt", "createddate", TS),
        Field("modified_dt", "modifieddate", TS),
    ),
    keys=("customer_id",),
    modified="modified_dt",
    surrogate="customer_hk",
    tracking=(
        "name", "mobile", "email", "login_by_using", "gender", "dob", "anniversary", "preferences",
    ),
    required=("customer_id", "name"),
)

CUSTOMER_ADDRESS = Entity(
    name="customeraddress",
    fields=(
        Field("address_id", "addressid", KEY),
        Field("customer_id_fk", "customerid", KEY),
        Field("flat_no", "flatno"),
        Field("house_no", "houseno"),
        Field("floor", "floor"),
        Field("building", "building"),
        Field("landmark", "landmark"),
        Field("locality", "locality"),
        Field("city", "city"),
        Field("state", "state"),
        Field("pincode", "pincode"),
        Field("coordinates", "coordinates"),
        Field("primary_flag", "primaryflag"),
        Field("address_type", "addresstype"),
        Field("created_date", "createddate", TS),
        Field("modified_date", "modifieddate", TS),
    ),
    keys=("address_id",),
    modified="modified_date",
    surrogate="customer_address_hk",
    tracking=(
        "customer_id_fk", "flat_no", "house_no", "floor", "building", "landmark", "locality", "city",
        "state", "pincode", "coordinates", "primary_flag", "address_type",
    ),
    required=("address_id",),
    foreign_keys=(ForeignKey("customer_id_fk", "customer", "customer_id"),),
)

MENU = Entity(
    name="menu",
    fields=(
        Field("menu_id", "menuid", KEY),
        Field("restaurant_id_fk", "restaurantid", KEY),
        Field("item_name", "itemname", TRIM),
        Field("description", "description", TRIM),
        Field("price", "price", "decimal(10,2)"),
        Field("category", "category", TRIM),
        Field("availability", "availability", BOOL),
        Field("item_type", "itemtype", TRIM),
        Field("created_dt", "createddate", TS),
        Field("modified_dt", "modifieddate", TS),
    ),
    keys=("menu_id",),
    modified="modified_dt",
    surrogate="menu_dim_hk",
    tracking=(
        "restaurant_id_fk", "item_name", "description", "price", "category", "availability", "item_type",
    ),
    required=("menu_id", "item_name", "price"),
    foreign_keys=(ForeignKey("restaurant_id_fk", "restaurant", "restaurant_id"),),
)

DELIVERY_AGENT = Entity(
    name="deliveryagent",
    fields=(
        Field("delivery_agent_id", "deliveryagentid", KEY),
        Field("name", "name"),
        Field("phone", "phone"),
        Field("vehicle_type", "vehicletype"),
        Field("location_id_fk", "locationid", KEY),
        Field("status", "status"),
        Field("gender", "gender"),
        Field("rating", "rating", "decimal(4,2)"),
        Field("created_dt", "createddate", TS),
        Field("modified_dt", "modifieddate", TS),
    ),
    keys=("delivery_agent_id",),
    modified="modified_dt",
    surrogate="delivery_agent_hk",
    tracking=("name", "phone", "vehicle_type", "location_id_fk", "status", "gender", "rating"),
    required=("delivery_agent_id", "name"),
    foreign_keys=(ForeignKey("location_id_fk", "location", "location_id"),),
)

DELIVERY = Entity(
    name="delivery",
    fields=(
        Field("delivery_id", "deliveryid", KEY),
        Field("order_id_fk", "orderid", KEY),
        Field("delivery_agent_id_fk", "deliveryagentid", KEY),
        Field("delivery_status", "deliverystatus"),
        Field("estimated_time", "estimatedtime"),
        Field("customer_address_id_fk", "addressid", KEY),
        Field("delivery_date", "deliverydate", TS),
        Field("created_date", "createddate", TS),
        Field("modified_date", "modifieddate", TS),
    ),
    keys=("delivery_id", "order_id_fk", "delivery_agent_id_fk"),
    created="created_date",
    modified="modified_date",
    required=("delivery_id", "order_id_fk"),
    foreign_keys=(
        ForeignKey("order_id_fk", "orders", "order_id"),
        ForeignKey("delivery_agent_id_fk", "deliveryagent", "delivery_agent_id"),
        ForeignKey("customer_address_id_fk", "customeraddress", "address_id"),
    ),
)

ORDERS = Entity(
    name="orders",
    fields=(
        Field("order_id", "orderid", KEY),
        Field("customer_id_fk", "customerid", KEY),
        Field("restaurant_id_fk", "restaurantid", KEY),
        Field("order_date", "orderdate", TS),
        Field("total_amount", "totalamount", "decimal(10,2)"),
        Field("status", "status"),
        Field("payment_method", "paymentmethod"),
        Field("created_dt", "createddate", TS),
        Field("modified_dt", "modifieddate", TS),
    ),
    keys=("order_id",),
    created="created_dt",
    modified="modified_dt",
    # Later deliveries of an order may only change these.
    update_columns=("total_amount", "status", "payment_method", "modified_dt"),
    required=("order_id", "customer_id_fk", "restaurant_id_fk"),
    foreign_keys=(
        ForeignKey("customer_id_fk", "customer", "customer_id"),
        ForeignKey("restaurant_id_fk", "restaurant", "restaurant_id"),
    ),
)

ORDER_ITEM = Entity(
    name="order_item",
    fields=(
        Field("order_item_id", "orderitemid", KEY),
        Field("order_id_fk", "orderid", KEY),
        Field("menu_id_fk", "menuid", KEY),
        Field("quantity", "quantity", "decimal(10,2)"),
        Field("price", "price", "decimal(10,2)"),
        Field("subtotal", "subtotal", "decimal(10,2)"),
        Field("created_dt", "createddate", TS),
        Field("modified_dt", "modifieddate", TS),
    ),
    keys=("order_item_id", "order_id_fk", "menu_id_fk"),
    created="created_dt",
    modified="modified_dt",
    required=("order_item_id", "order_id_fk", "menu_id_fk"),
    foreign_keys=(
        ForeignKey("order_id_fk", "orders", "order_id"),
        ForeignKey("menu_id_fk", "menu", "menu_id"),
    ),
)

ENTITIES = {
    e.name: e
    for e in (
        LOCATION, RESTAURANT, CUSTOMER, CUSTOMER_ADDRESS, MENU, DELIVERY_AGENT, DELIVERY, ORDERS, ORDER_ITEM,
    )
}
DIMENSIONS = [e for e in ENTITIES.values() if e.surrogate]
