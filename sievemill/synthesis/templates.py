"""Ready-made tables: industries, domains, complexity levels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.columns import clip, cut_labels
from sievemill.session import spread
from sievemill.synthesis.draw import Draw
from sievemill.synthesis.generate import generic_column

# --- fixed values: codes, names and weights of the industries ------------------------------------
ICD10 = [
    "J06.9", "I10", "E11.9", "K21.9", "M79.3", "R50.9", "J20.9", "N39.0", "K92.2", "R06.02",
    "R51", "J02.9", "M25.511", "F32.9", "E78.5", "B34.9", "R10.9", "J45.909", "L03.90", "S01.00XA",
]
ICD10_WEIGHTS = [20, 18, 15, 12, 10] + [5] * 5 + [2] * 10
INSURERS = {
    "BlueCross BlueShield": 0.25, "Aetna": 0.20, "UnitedHealth": 0.15, "Kaiser Permanente": 0.10, "Cigna": 0.08,
    "Humana": 0.07, "Anthem": 0.05, "Centene": 0.04, "Molina Healthcare": 0.03, "WellCare": 0.03,
}
DEPARTMENTS = [
    "Emergency", "Cardiology", "Orthopedics", "Pediatrics", "Oncology",
    "Neurology", "Psychiatry", "Radiology", "Surgery", "Internal Medicine",
]
MERCHANTS = {
    "Retail": ["Walmart", "Target", "Best Buy", "Home Depot", "Costco"],
    "Food": ["Starbucks", "McDonalds", "Chipotle", "Subway", "Pizza Hut"],
    "Travel": ["United Airlines", "Marriott", "Uber", "Lyft", "Hertz"],
    "Entertainment": ["Netflix", "Spotify", "AMC Theaters", "Disney+", "Hulu"],
    "Services": ["AT&T", "Verizon", "Comcast", "State Farm", "Geico"],
    "Gas": ["Shell", "Exxon", "BP", "Chevron", "Mobil"],
    "Groceries": ["Kroger", "Safeway", "Whole Foods", "Trader Joes", "Albertsons"],
}
MERCHANT_WEIGHTS = [0.25, 0.20, 0.15, 0.15, 0.10, 0.10, 0.05]
PRODUCTS = {
    "Electronics": ["Laptop", "Smartphone", "Tablet", "Headphones", "Smart Watch"],
    "Clothing": ["T-Shirt", "Jeans", "Dress", "Jacket", "Shoes"],
    "Home": ["Sofa", "Table", "Lamp", "Rug", "Curtains"],
    "Food": ["Coffee", "Bread", "Milk", "Eggs", "Chicken"],
    "Sports": ["Basketball", "Yoga Mat", "Running Shoes", "Weights", "Bike"],
    "Books": ["Fiction Novel", "Cookbook", "Biography", "Textbook", "Magazine"],
    "Toys": ["LEGO Set", "Board Game", "Action Figure", "Puzzle", "Doll"],
}
VARIANTS = ["", " Pro", " Plus", " Basic", " Premium", " XL", " Mini"]
SKU_PREFIXES = ["ELC", "CLO", "HOM", "FOD", "SPT", "BOK", "TOY"]
PART_SUFFIXES = ["AA", "AB", "AC", "BA", "BB", "CA"]
TRANSACTION_TYPES = {"Debit": 0.35, "Credit": 0.25, "Transfer": 0.15, "ATM": 0.10, "Online": 0.10, "Check": 0.05}
PAYMENT_METHODS = {"Credit Card": 0.40, "Debit Card": 0.25, "PayPal": 0.15, "Apple Pay": 0.10, "Google Pay": 0.08, "Cash": 0.02}
SUPPLIER_WEIGHTS = [30, 25, 20, 10, 5, 3, 3, 2, 1, 1]
# -----------------------------------------------------------------------------------------------

# --- fixed values: lists and weights of the domain tables and levels --------------------------------
SHOP_CATEGORIES = ["Electronics", "Clothing", "Books", "Home", "Sports"]
SHOP_PAYMENTS = {"Credit Card": 0.5, "PayPal": 0.3, "Debit Card": 0.15, "Bitcoin": 0.05}
SHOP_STATUS = {"Pending": 0.1, "Shipped": 0.2, "Delivered": 0.65, "Cancelled": 0.05}
PATIENT_GENDERS = {"M": 0.48, "F": 0.50, "Other": 0.02}
BLOOD_TYPES = ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"]
DIAGNOSES = ["Diabetes", "Hypertension", "Cardiac", "Respiratory", "Other"]
MONEY_MOVES = {"Deposit": 0.3, "Withdrawal": 0.3, "Transfer": 0.2, "Payment": 0.2}
SPENDING = ["Food", "Transport", "Entertainment", "Bills", "Shopping", "Other"]
SENSORS = ["Temperature", "Humidity", "Pressure", "Motion"]
UNITS = ["C", "%", "kPa", "boolean"]
TEAMS = ["Sales", "Engineering", "Marketing", "HR"]
GRADES = ["Junior", "Mid", "Senior", "Lead"]
GRADE_YEARS = [0, 2, 5, 10, 40]
GENDERS = {"Male": 0.49, "Female": 0.49, "Other": 0.02}
TITLES = ["Dr.", "Dr.", "Dr.", "Prof."]
PRICE_ENDINGS = [0.99, 0.95, 0.0]
GOODS = ["Widget", "Gadget", "Device", "Tool", "Item"]
# -----------------------------------------------------------------------------------------------

# --- fixed values: words of each mood -------------------------------------------------------------
MOODS = {
    "positive": ["excellent", "great", "wonderful", "amazing", "fantastic", "love"],
    "negative": ["terrible", "horrible", "awful", "hate", "worst", "disappointed"],
    "neutral": ["okay", "fine", "adequate", "acceptable", "moderate", "average"],
}
# -----------------------------------------------------------------------------------------------


def gen_sentiment(d: Draw, name: str) -> Column:
    """A mood word and a sentence; the mood is drawn first."""
    mood = d.choice(f"{name}.mood", list(MOODS))
    word = F.lit(None).cast("string")
    for m, words in MOODS.items():
        word = F.when(mood == m, d.choice(f"{name}.{m}", words)).otherwise(word)
    return F.concat(F.initcap(word), F.lit("! "), d.sentence(name))


def _by_category(d: Draw, name: str, table: Mapping[str, Sequence[str]]) -> Column:
    # a category first, then a member of it, both with equal weight
    flat = [v for values in table.values() for v in values]
    return d.choice(name, flat)


def _days_ago(d: Draw, name: str, days: int, as_of: str) -> Column:
    return F.date_sub(F.to_date(F.lit(as_of)), d.integer(name, 0, days).cast("int"))


def business_moment(d: Draw, name: str, as_of: str) -> Column:
    """Timestamp of the last year: most weekend days move back one or two days, hours peak at 14.

    A day that is not moved stays, so 30 % of Saturdays do.  Two moves at most can happen: Sunday, Saturday, weekday.
    """
    day = _days_ago(d, f"{name}.day", 365, as_of)
    going = F.lit(True)
    for i in range(2):
        going = going & (F.weekday(day) >= 5) & d.chance(f"{name}.move{i}", 0.7)
        day = F.when(going, F.date_sub(day, d.integer(f"{name}.back{i}", 1, 2).cast("int"))).otherwise(day)
    hour = d.normal(f"{name}.hour", 14, 4, 0, 23).cast("int")
    minute = d.integer(f"{name}.minute", 0, 59).cast("int")
    return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + hour * 3600 + minute * 60)


def holiday_day(d: Draw, name: str, as_of: str) -> Column:
    """Day of the last year; 30 % of November and December days move to 24-30 November."""
    day = _days_ago(d, f"{name}.day", 365, as_of)
    surge = F.make_date(F.year(day), F.lit(11), d.integer(f"{name}.surge", 24, 30).cast("int"))
    return F.when(F.month(day).isin(11, 12) & d.chance(f"{name}.holiday", 0.3), surge).otherwise(day)


def account_number(d: Draw, name: str) -> Column:
    """Nine digits and their sum modulo 10."""
    nine = d.digits(name, 9)
    total = F.aggregate(F.transform(F.split(nine, ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return F.concat(nine, (total % 10).cast("string"))


def healthcare(d: Draw, as_of: str, n: int) -> dict[str, Column]:
    return {
        "patient_id": d.code("patient_id", "P", 8),
        "patient_name": d.full_name("patient_name"),
        "age": d.normal("age", 45, 20, 0, 100).cast("int"),
        "gender": d.weighted("gender", GENDERS),
        "diagnosis_code": d.weighted("diagnosis_code", dict(zip(ICD10, ICD10_WEIGHTS))),
        "admission_date": _days_ago(d, "admission_date", 730, as_of),
        "treatment_cost": F.round(clip(d.lognormal("treatment_cost", 8.5, 1.5), 100.0, 500000.0), 2),
        "insurance_provider": d.weighted("insurance_provider", INSURERS),
        "doctor_name": F.concat_ws(" ", d.choice("title", TITLES), d.full_name("doctor_name")),
        "department": d.choice("department", DEPARTMENTS),
    }


def finance(d: Draw, as_of: str, n: int) -> dict[str, Column]:
    small, large = d.lognormal("amount.small", 3.0, 1.0), d.lognormal("amount.large", 6.0, 0.8)
    return {
        "transaction_id": d.code("transaction_id", "TXN", 12),
        "account_number": account_number(d, "account_number"),
        "customer_name": d.full_name("customer_name"),
        "transaction_amount": F.round(F.least(F.when(d.chance("amount.kind", 0.8), small).otherwise(large), F.lit(10000.0)), 2),
        "transaction_datetime": business_moment(d, "transaction_datetime", as_of),
        "transaction_type": d.weighted("transaction_type", TRANSACTION_TYPES),
        "merchant_name": _by_category(d, "merchant_name", MERCHANTS),
        "merchant_category": d.weighted("merchant_category", dict(zip(MERCHANTS, MERCHANT_WEIGHTS))),
        "balance_after": F.round(F.least(d.pareto("balance_after", 1.16) * 1000, F.lit(1000000.0)), 2),
        "location": d.city_state("location"),
    }


def skewed_customer(d: Draw, name: str, customers: int, prefix: str = "CUST", width: int = 8) -> Column:
    """Customer number with few heavy buyers: the inverse of a power-law share of the order volume."""
    rank = F.floor(F.pow(d.uniform(name), F.lit(3.0)) * F.lit(float(customers)))
    return F.concat(F.lit(prefix), F.lpad(rank.cast("bigint").cast("string"), width, "0"))


def retail(d: Draw, as_of: str, n: int) -> dict[str, Column]:
    price = F.floor(d.lognormal("price", 3.5, 1.2)) + d.choice("price.ending", PRICE_ENDINGS)
    return {
        "order_id": d.code("order_id", "ORD", 10),
        "customer_id": skewed_customer(d, "customer_id", max(1, n // 3)),
        "customer_name": d.full_name("customer_name"),
        "customer_email": d.email("customer_email", unique=True),
        "product_id": F.concat(d.choice("sku", SKU_PREFIXES), F.lit("-"), d.integer("sku.no", 1000, 9999).cast("string")),
        "product_name": F.concat(_by_category(d, "product_name", PRODUCTS), d.choice("variant", VARIANTS)),
        "price": F.round(clip(price, 0.99, 999.99), 2),
        "quantity": F.least(d.geometric("quantity", 0.6), F.lit(20)),
        "category": d.weighted("category", {c: 1 / (i + 1) for i, c in enumerate(PRODUCTS)}),
        "order_date": holiday_day(d, "order_date", as_of),
        "shipping_address": d.address("shipping_address"),
        "payment_method": d.weighted("payment_method", PAYMENT_METHODS),
    }


def manufacturing(d: Draw, as_of: str, n: int) -> dict[str, Column]:
    return {
        "part_number": F.concat(F.lit("PRT-"), d.integer("part", 1000, 9999).cast("string"), F.lit("-"), d.choice("part.end", PART_SUFFIXES)),
        "stock_quantity": d.normal("stock", 500, 150, 0).cast("int"),
        "quality_score": F.round(d.normal("quality", 99.7, 0.3, 95, 100), 2),
        "supplier": d.weighted("supplier", {f"Supplier {chr(65 + i)}": w for i, w in enumerate(SUPPLIER_WEIGHTS)}),
        "production_date": _days_ago(d, "production_date", 365, as_of),
    }


def insurance(d: Draw, as_of: str, n: int) -> dict[str, Column]:
    return {
        "policy_number": d.code("policy_number", "POL", 10),
        "claim_amount": F.round(F.least(d.lognormal("claim_amount", 7.5, 1.8), F.lit(1000000.0)), 2),
        "premium_amount": F.round(d.normal("premium_amount", 300, 100, 50), 2),
        "risk_score": F.round(d.beta("risk_score", 2, 5) * 100, 1),
        "start_date": _days_ago(d, "start_date", 365, as_of),
    }


INDUSTRIES = {"healthcare": healthcare, "finance": finance, "retail": retail, "manufacturing": manufacturing, "insurance": insurance}

# --- fixed values: relations between the columns of a template ------------------------------------
RELATIONS = {
    "healthcare": [{"type": "dependent", "source": "admission_date", "target": "discharge_date"}],
    "finance": [],
    "retail": [
        {"type": "lookup", "source": "product_id", "target": "product_name", "values": [v for names in PRODUCTS.values() for v in names]},
        {"type": "calculation", "source": "price,quantity", "target": "total"},
    ],
    "insurance": [{"type": "dependent", "source": "start_date", "target": "end_date"}],
    "manufacturing": [],
}
# -----------------------------------------------------------------------------------------------


def custom_column(d: Draw, c: Mapping, as_of: str) -> Column:
    """Column of a custom template from its settings."""
    name, kind = c["name"], c.get("type", "string")
    if kind == "account":
        width = c.get("length", 10)
        if c.get("pattern", "sequential") == "uuid":
            return F.substring(d.uuid(name), 1, width)
        if c.get("pattern", "sequential") == "sequential":
            return F.concat(F.lit("ID"), F.lpad(d.key.cast("string"), width, "0"))
        return F.concat(F.lit("ACC"), d.digits(name, width))
    if kind in ("currency", "float"):
        return d.real(name, c.get("min", 0), c.get("max", 1000 if kind == "currency" else 100), 2)
    if kind == "integer":
        return d.integer(name, c.get("min", 0), c.get("max", 100))
    if kind == "category":
        return d.choice(name, c.get("categories", ["Category1", "Category2"]))
    if kind == "email":
        return d.email(name, unique=c.get("unique", False))
    if kind == "name":
        return {"first": d.first_name, "last": d.last_name}.get(c.get("nameType"), d.full_name)(name)
    if kind == "address":
        return {"city": d.city, "city-state": d.city_state}.get(c.get("addressType"), d.address)(name)
    if kind in ("date", "datetime"):
        start, end = c.get("minDate", "2023-01-01"), c.get("maxDate", as_of)
        return d.date(name, start, end) if kind == "date" else d.moment(name, start, end)
    if kind == "string" and c.get("pattern"):
        pattern = {
            "icd10": lambda: F.concat(d.choice(name, list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), d.integer(f"{name}.a", 10, 99).cast("string"), F.lit("."), d.integer(f"{name}.b", 0, 9).cast("string")),
            "sku": lambda: F.concat(F.lit("SKU-"), d.integer(name, 1000, 9999).cast("string")),
            "zipcode": lambda: d.integer(name, 10000, 99999).cast("string"),
            "company": lambda: d.company(name),
            "product": lambda: F.concat(d.choice(name, GOODS), F.lit(" "), d.integer(f"{name}.n", 100, 999).cast("string")),
        }
        if c["pattern"] in pattern:
            return pattern[c["pattern"]]()
    return generic_column(d, name, kind, as_of)


def generate_template(base: DataFrame, key: str, industry: str, n: int, seed: int = 42, as_of: str = "2024-01-01", columns: Sequence[Mapping] | None = None) -> DataFrame:
    """Industry table with its relations, or a custom one from ``columns``.  The row key is kept."""
    from sievemill.synthesis.generate import apply_relations

    d = Draw(seed, F.col(key))
    if industry == "custom":
        return base.select(key, *[custom_column(d, c, as_of).alias(c["name"]) for c in columns or []])
    made = base.select(key, *[e.alias(c) for c, e in INDUSTRIES[industry](d, as_of, n).items()])
    return apply_relations(made, RELATIONS[industry], key, seed)


def ecommerce(d: Draw, n: int, as_of: str) -> dict[str, Column]:
    price, quantity = F.round(d.lognormal("price", 3, 1), 2), d.geometric("quantity", 0.3)
    return {
        "order_id": F.concat(F.lit("ORD"), F.lpad((d.key + 1).cast("string"), 8, "0")),
        "customer_id": F.concat(F.lit("CUST"), F.lpad(d.integer("customer", 1, max(1, n // 10 - 1)).cast("string"), 6, "0")),
        "product_id": F.concat(F.lit("PROD"), F.lpad(d.integer("product", 1, 999).cast("string"), 5, "0")),
        "product_name": F.initcap(F.concat_ws(" ", d.word("p1"), d.word("p2"))),
        "category": d.choice("category", SHOP_CATEGORIES),
        "price": price, "quantity": quantity,
        "order_date": d.moment("order_date", _year_before(as_of), as_of),
        "shipping_address": d.address("shipping_address"),
        "payment_method": d.weighted("payment_method", SHOP_PAYMENTS),
        "status": d.weighted("status", SHOP_STATUS),
        "total_amount": F.round(price * quantity, 2),
    }


def _year_before(as_of: str, years: int = 1) -> str:
    return f"{int(as_of[:4]) - years}{as_of[4:]}"


def patients(d: Draw, n: int, as_of: str) -> dict[str, Column]:
    return {
        "patient_id": F.concat(F.lit("PAT"), F.lpad((d.key + 1).cast("string"), 6, "0")),
        "age": d.beta("age", 5, 2) * 100,
        "gender": d.weighted("gender", PATIENT_GENDERS),
        "blood_type": d.choice("blood_type", BLOOD_TYPES),
        "admission_date": d.date("admission_date", _year_before(as_of, 2), as_of),
        "diagnosis": d.choice("diagnosis", DIAGNOSES),
        "treatment": d.sentence("treatment", 5),
        "blood_pressure_sys": d.normal("sys", 120, 20, 80, 200),
        "blood_pressure_dia": d.normal("dia", 80, 10, 50, 120),
        "heart_rate": d.normal("heart_rate", 72, 12, 40, 150),
        "temperature": d.normal("temperature", 98.6, 1, 95, 105),
        "length_of_stay": clip(d.exponential("length_of_stay", 5), 1.0, 30.0),
    }


def financial(d: Draw, n: int, as_of: str) -> dict[str, Column]:
    return {
        "transaction_id": d.uuid("transaction_id"),
        "account_id": F.concat(F.lit("ACC"), F.lpad(d.integer("account", 1, max(1, n // 20 - 1)).cast("string"), 8, "0")),
        "transaction_date": d.moment("transaction_date", _year_before(as_of), as_of),
        "transaction_type": d.weighted("transaction_type", MONEY_MOVES),
        "amount": F.round(d.lognormal("amount", 5, 2), 2),
        "balance_after": F.round(d.lognormal("balance_after", 8, 1), 2),
        "merchant": F.when(d.chance("merchant.known", 0.7), d.company("merchant")),
        "category": d.choice("category", SPENDING),
        "fraud_flag": d.chance("fraud_flag", 0.005).cast("int"),
    }


def iot(d: Draw, n: int, as_of: str) -> dict[str, Column]:
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    daily = F.sin(d.key * F.lit(2 * math.pi / 1440)) * 10
    return {
        "timestamp": F.timestamp_seconds(start + d.key * 60),
        "device_id": F.concat(F.lit("DEV"), F.lpad(d.integer("device", 1, 99).cast("string"), 4, "0")),
        "sensor_type": d.choice("sensor_type", SENSORS),
        "value": d.normal("value", 25, 5) + daily,
        "unit": d.choice("unit", UNITS),
        "location": F.concat(F.lit("Zone-"), d.integer("location", 1, 9).cast("string")),
        "battery_level": d.real("battery_level", 0, 100),
        "signal_strength": d.real("signal_strength", -100, -30),
        "anomaly_score": d.beta("anomaly_score", 2, 8),
    }


DOMAIN_TABLES = {"ecommerce": ecommerce, "healthcare": patients, "financial": financial, "iot": iot}


def generate_domain(base: DataFrame, key: str, name: str, n: int, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    """Domain table: ecommerce, healthcare, financial, iot."""
    return base.select(*[e.alias(c) for c, e in DOMAIN_TABLES[name](Draw(seed, F.col(key)), n, as_of).items()])


LEVELS = ("simple", "moderate", "complex", "very_complex")


def generate_complexity(base: DataFrame, key: str, level: str, n: int, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    """Employee table of rising complexity; each level adds columns to the one before.

    A row costs far more to make than its key to move, and the keys of many rows fit one partition of a file, so the
    keys are dealt out over all cores first.
    """
    depth = LEVELS.index(level)
    d = Draw(seed, F.col("_k"))
    df = spread(base.select(F.col(key).alias("_k"))).select(
        "_k", (d.key + 1).alias("id"), d.full_name("name").alias("name"), d.integer("age", 18, 79).alias("age"),
        F.round(d.normal("salary", 50000, 15000), 2).alias("salary"), d.choice("department", TEAMS).alias("department"),
        d.date("joined_date", _year_before(as_of, 5), as_of).alias("joined_date"),
    )
    if depth >= 1:
        df = df.withColumns({
            "email": F.concat(F.lower(F.replace(F.col("name"), F.lit(" "), F.lit("."))), F.lit("@company.com")),
            "phone": d.phone("phone"), "address": d.address("address"),
            "experience_years": clip((F.col("age") - 22) * d.real("experience", 0.5, 0.8), 0.0, 40.0).cast("int"),
            "performance_score": d.beta("performance", 5, 2) * 100,
        })
        level_edges = cut_labels(F.col("experience_years"), GRADE_YEARS, GRADES)
        df = df.withColumns({
            "bonus": F.col("salary") * F.col("performance_score") / 100 * 0.2,
            # the first bin is open at 0, as no years is no level
            "level": F.when(F.col("experience_years") > 0, level_edges),
        })
    if depth >= 2:
        wave = F.sin(d.key * F.lit(2 * math.pi / 365)) * 500 + F.sin(d.key * F.lit(2 * math.pi / 7)) * 200
        words = F.array(*[d.word(f"tag{i}") for i in range(4)])
        df = df.withColumns({
            "transaction_date": F.date_add(F.to_date(F.lit("2020-01-01")), (d.key % 36500).cast("int")),
            "daily_sales": F.greatest(F.lit(0.0), F.lit(1000.0) + wave + d.normal("sales", 0, 100)),
            "metadata": F.struct(
                F.slice(words, 1, d.integer("tags", 1, 4).cast("int")).alias("tags"),
                F.struct(*[d.real(f"score.{s}", 0, 1).alias(s) for s in ("quality", "efficiency", "innovation")]).alias("scores"),
            ),
            "email": F.when(F.col("age") <= 60, F.col("email")),
            "phone": F.when(~d.chance("phone.missing", 0.1), F.col("phone")),
            "salary": F.when(d.chance("salary.outlier", 0.05), F.col("salary") * d.real("salary.factor", 2, 3)).otherwise(F.col("salary")),
        })
    if depth >= 3:
        part = d.integer("component", 0, 2)
        centre = F.element_at(F.array(*[F.lit(x) for x in (-1.0, 0.0, 1.0)]), (part + 1).cast("int"))
        back = d.integer("manager.back", 1, 10)
        df = df.withColumns({
            "customer_value": (centre + d.normal("value", 0, 0.6)) * 1000 + 5000,
            "purchase_frequency": (centre + d.normal("frequency", 0, 0.6)) * 10 + 20,
            # a manager comes from the ten rows before
            "manager_id": F.when((d.key > 0) & d.chance("manager", 0.8), F.greatest(F.col("id") - back, F.lit(1))),
            "latitude": d.real("latitude", -90, 90), "longitude": d.real("longitude", -180, 180),
            "comments": gen_sentiment(d, "comments"),
            "image_embedding": embedding(d, "image", 128),
        })
    return df.drop("_k")


def embedding(d: Draw, name: str, size: int) -> Column:
    """Array of normal draws; one transform over an index array keeps the expression small."""
    span = float(16**13)

    def unit(tag: str, i: Column) -> Column:
        text = F.concat(F.lit(f"{d.seed}:{name}{tag}:"), d.key.cast("string"), F.lit(":"), i.cast("string"))
        return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(span)

    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.sqrt(F.log(unit("#r", i)) * -2.0) * F.cos(unit("#a", i) * (2 * math.pi)),
    )


