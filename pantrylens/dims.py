"""Dimensions of the label domain: fixed values, stated plainly, and the small tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Surface forms of the three fused allergens; the order of allergens is output order.
ALLERGENS = ("MILK", "SOY", "WHEAT")
ALLERGEN_FORMS = {
    "MILK": (
        "milk", "whole milk", "milk powder", "whole milk powder", "skim milk", "skimmed milk", "butter", "cream", "whey", "casein", "caseinate",
    ),
    "SOY": (
        "soy", "soya", "soybean", "soy bean", "soy lecithin", "soya lecithin", "soybean oil", "soya oil", "soy sauce", "soya sauce",
    ),
    "WHEAT": (
        "wheat", "wheat flour", "whole wheat", "whole wheat flour", "enriched flour", "bread flour",
    ),
}
# Other ingredients as (surface, concept).
INGREDIENT_FORMS = (
    ("rice flour", "rice flour"),
    ("rice", "rice"),
    ("semisweet chocolate chips", "chocolate chips"),
    ("chocolate chips", "chocolate chips"),
    ("potato", "potato"),
    ("potatoes", "potato"),
    ("sunflower oil", "sunflower oil"),
    ("sunflower", "sunflower"),
    ("canola oil", "canola oil"),
    ("rapeseed oil", "canola oil"),
    ("safflower oil", "safflower oil"),
    ("sea salt", "salt"),
    ("salt", "salt"),
    ("black pepper", "black pepper"),
    ("jalapeno pepper powder", "jalapeno pepper powder"),
    ("jalapeno", "jalapeno"),
    ("citric acid", "citric acid"),
    ("acidulant", "acidulant"),
    ("natural flavor", "natural flavor"),
    ("artificial flavor", "artificial flavor"),
    ("natural and artificial flavor", "natural and artificial flavor"),
    ("garlic powder", "garlic powder"),
    ("onion powder", "onion powder"),
    ("sugar", "sugar"),
    ("dextrose", "dextrose"),
    ("cocoa butter", "cocoa butter"),
    ("cocoa", "cocoa"),
    ("corn syrup", "corn syrup"),
    ("high fructose corn syrup", "high fructose corn syrup"),
    ("baking soda", "baking soda"),
    ("sodium bicarbonate", "baking soda"),
    ("caramel color", "caramel color"),
    ("chocolate", "chocolate"),
    ("cottonseed oil", "cottonseed oil"),
    ("partially hydrogenated cottonseed oil", "partially hydrogenated cottonseed oil"),
    ("niacin", "niacin"),
    ("reduced iron", "reduced iron"),
    ("thiamine mononitrate", "thiamine mononitrate"),
    ("vitamin b1", "vitamin b1"),
    ("riboflavin", "riboflavin"),
    ("vitamin b2", "vitamin b2"),
    ("folic acid", "folic acid"),
)
# The nine-allergen ontology; the order of synonyms decides which one is reported.
NINE = {
    "WHEAT": (
        "WHEAT", "WHEAT FLOUR", "ENRICHED FLOUR", "ENRICHED WHEAT FLOUR", "WHOLE WHEAT", "WHOLE WHEAT FLOUR", "BREAD FLOUR", "DURUM", "DURUM WHEAT",
        "SEMOLINA", "SPELT", "BULGUR", "FARINA", "GRAHAM FLOUR", "VITAL WHEAT GLUTEN", "WHEAT GLUTEN", "COUSCOUS", "WHEAT STARCH", "WHEAT BRAN",
    ),
    "SOY": (
        "SOY", "SOYBEAN", "SOYBEAN OIL", "SOY LECITHIN", "SOYA", "SOYA SAUCE", "SOY SAUCE", "TEXTURED VEGETABLE PROTEIN", "TVP", "TOFU", "EDAMAME",
        "MISO", "TEMPEH", "HYDROLYZED SOY PROTEIN",
    ),
    "MILK": (
        "MILK", "BUTTER", "CHEESE", "COTTAGE CHEESE", "CREAM", "WHEY", "CASEIN", "CASEINATE", "SODIUM CASEINATE", "LACTOSE", "GHEE", "CUSTARD",
        "YOGURT", "SOUR CREAM", "MILK SOLIDS", "NONFAT MILK POWDER", "BUTTERMILK", "MILK POWDER",
    ),
    "EGG": (
        "EGG", "EGGS", "EGG WHITE", "EGG YOLK", "WHOLE EGG", "ALBUMIN", "OVALBUMIN", "MAYONNAISE", "MERINGUE", "LYSOZYME", "DRIED EGG", "EGG POWDER",
    ),
    "PEANUT": (
        "PEANUT", "PEANUTS", "PEANUT OIL", "PEANUT BUTTER", "GROUNDNUT", "GROUND NUT", "ARACHIS OIL", "PEANUT FLOUR",
    ),
    "TREE_NUT": (
        "ALMOND", "ALMONDS", "CASHEW", "CASHEWS", "WALNUT", "WALNUTS", "PECAN", "PECANS", "PISTACHIO", "PISTACHIOS", "HAZELNUT", "HAZELNUTS",
        "MACADAMIA", "MACADAMIA NUT", "BRAZIL NUT", "BRAZIL NUTS", "PINE NUT", "PINE NUTS", "NUT BUTTER", "ALMOND MILK", "CASHEW BUTTER",
    ),
    "FISH": (
        "FISH", "ANCHOVY", "ANCHOVIES", "COD", "SALMON", "TUNA", "TILAPIA", "FISH SAUCE", "FISH OIL", "SURIMI", "BASS", "TROUT",
    ),
    "SHELLFISH": (
        "SHRIMP", "PRAWN", "PRAWNS", "CRAB", "LOBSTER", "CRAWFISH", "CRAYFISH", "CRUSTACEAN", "SHELLFISH",
    ),
    "SESAME": (
        "SESAME", "SESAME SEED", "SESAME SEEDS", "SESAME OIL", "TAHINI", "SESAME FLOUR", "SESAME PASTE", "BENNE SEED",
    ),
}
# The names that reports show.
NAMES = {"WHEAT": "Wheat", "SOY": "Soy", "MILK": "Milk", "EGG": "Egg", "PEANUT": "Peanut", "TREE_NUT": "Tree Nuts", "FISH": "Fish", "SHELLFISH": "Shellfish (Crustacean)", "SESAME": "Sesame"}
# The baseline detector's keywords.
BASELINE = {
    "WHEAT": (
        "WHEAT", "WHEAT FLOUR", "ENRICHED FLOUR", "WHOLE WHEAT", "BREAD FLOUR",
    ),
    "SOY": (
        "SOY", "SOYBEAN", "SOYBEAN OIL", "SOY LECITHIN", "SOYA", "SOYA SAUCE",
    ),
    "MILK": (
        "MILK", "BUTTER", "CHEESE", "COTTAGE CHEESE", "CREAM", "WHEY", "CASEIN", "CASEINATE",
    ),
}
# Substrings that make recognized text plausible.
OCR_WORDS = (
    "INGREDIENT", "INGREDIENTS", "CONTAINS", "FLOUR", "WHEAT", "MILK", "SOY", "SOYBEAN", "EGG", "PEANUT", "NUT", "BUTTER", "OIL", "SUGAR", "SALT",
    "STARCH", "CREAM", "COCOA", "CHOCOLATE", "LECITHIN", "PROTEIN", "SYRUP", "POWDER",
)
# Bracketed remarks that are no ingredients.
REMARKS = (
    "emulsifier", "preservative", "flavoring", "flavouring", "color", "colour", "stabilizer", "stabiliser", "thickener", "acidulant", "antioxidant",
    "processing aid",
)
# What the vision models' observations name, by observation.
CONCEPTS = {
    "grilled chicken with couscous and vegetables": "chicken",
    "sliced chicken breast": "chicken",
    "grilled pork tenderloin with quinoa and vegetables": "pork",
    "tomato": "tomato",
    "diced tomatoes": "tomato",
    "cucumber": "cucumber",
    "sliced lime on plate with vegetables": "lime",
    "lime wedges": "lime",
    "carrot": "carrot",
    "fresh cilantro": "cilantro",
    "quinoa": "quinoa",
}


def exact_index_rows() -> list[tuple[str, str, str | None]]:
    """(surface, concept, allergen); allergen forms win."""
    rows = {s: (s, a.lower(), a) for a in ALLERGENS for s in ALLERGEN_FORMS[a]}
    for surface, concept in INGREDIENT_FORMS:
        rows.setdefault(surface, (surface, concept, None))
    return list(rows.values())


def exact_index(spark: SparkSession) -> DataFrame:
    """69 fixed rows: small enough to broadcast whatever the data."""
    return spark.createDataFrame(exact_index_rows(), "surface string, concept string, allergen string")


def synonyms(spark: SparkSession, table: dict[str, tuple[str, ...]] = NINE) -> DataFrame:
    return spark.createDataFrame([(a, i, s) for a, names in table.items() for i, s in enumerate(names)], "allergen string, pos int, synonym string")


def sql_values(rows: list[tuple]) -> str:
    def lit(v):
        if isinstance(v, list | tuple):
            return "[" + ", ".join(map(lit, v)) + "]::VARCHAR[]"
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
