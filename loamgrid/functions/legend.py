"""Land-cover legend, groups and drought labels, as literal dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The published code legend.
LEGEND = {
    0: "Background",
    1: "Corn",
    2: "Cotton",
    3: "Rice",
    4: "Sorghum",
    5: "Soybeans",
    6: "Sunflower",
    10: "Peanuts",
    11: "Tobacco",
    12: "Sweet Corn",
    13: "Popcorn or Ornamental Corn",
    14: "Mint",
    21: "Barley",
    22: "Durum Wheat",
    23: "Spring Wheat",
    24: "Winter Wheat",
    25: "Other Small Grains",
    26: "Winter Wheat / Soybeans (double crop)",
    27: "Rye",
    28: "Oats",
    29: "Millet",
    30: "Speltz",
    31: "Canola",
    32: "Flaxseed",
    33: "Safflower",
    34: "Rape Seed",
    35: "Mustard",
    36: "Alfalfa",
    37: "Other Hay / Non-Alfalfa",
    38: "Camelina",
    39: "Buckwheat",
    41: "Sugarbeets",
    42: "Dry Beans",
    43: "Potatoes",
    44: "Other Crops",
    45: "Sugarcane",
    46: "Sweet Potatoes",
    47: "Miscellaneous Vegetables & Fruits",
    48: "Watermelons",
    49: "Onions",
    50: "Cucumbers",
    51: "Chick Peas",
    52: "Lentils",
    53: "Peas",
    54: "Tomatoes",
    55: "Caneberries",
    56: "Hops",
    57: "Herbs",
    58: "Clover / Wildflowers",
    59: "Sod / Grass Seed",
    60: "Switchgrass",
    61: "Fallow / Idle Cropland",
    63: "Forest",
    64: "Shrubland",
    65: "Barren",
    66: "Cherries",
    67: "Peaches",
    68: "Apples",
    69: "Grapes",
    70: "Christmas Trees",
    71: "Other Tree Crops",
    72: "Citrus",
    74: "Pecans",
    75: "Almonds",
    76: "Walnuts",
    77: "Pears",
    81: "Clouds / No Data",
    82: "Developed",
    83: "Water",
    87: "Wetlands",
    88: "Non-Agricultural / Undefined",
    92: "Aquaculture",
    111: "Open Water",
    112: "Perennial Ice / Snow",
    121: "Developed / Open Space",
    122: "Developed / Low Intensity",
    123: "Developed / Medium Intensity",
    124: "Developed / High Intensity",
    131: "Barren",
    141: "Deciduous Forest",
    142: "Evergreen Forest",
    143: "Mixed Forest",
    152: "Shrubland",
    176: "Grassland / Pasture",
    190: "Woody Wetlands",
    195: "Herbaceous Wetlands",
    204: "Pistachios",
    205: "Triticale",
    206: "Carrots",
    207: "Asparagus",
    208: "Garlic",
    209: "Cantaloupes",
    210: "Prunes",
    211: "Olives",
    212: "Oranges",
    213: "Honeydew Melons",
    214: "Broccoli",
    215: "Avocados",
    216: "Peppers",
    217: "Pomegranates",
    218: "Nectarines",
    219: "Greens",
    220: "Plums",
    221: "Strawberries",
    222: "Squash",
    223: "Apricots",
    224: "Vetch",
    225: "Winter Wheat / Corn (double crop)",
    226: "Oats / Corn (double crop)",
    227: "Lettuce",
    228: "Triticale / Corn (double crop)",
    229: "Pumpkins",
    230: "Lettuce / Durum Wheat (double crop)",
    231: "Lettuce / Cantaloupe (double crop)",
    232: "Lettuce / Cotton (double crop)",
    233: "Lettuce / Barley (double crop)",
    234: "Durum Wheat / Sorghum (double crop)",
    235: "Barley / Sorghum (double crop)",
    236: "Winter Wheat / Sorghum (double crop)",
    237: "Barley / Corn (double crop)",
    238: "Winter Wheat / Cotton (double crop)",
    239: "Soybeans / Cotton (double crop)",
    240: "Soybeans / Oats (double crop)",
    241: "Corn / Soybeans (double crop)",
    242: "Blueberries",
    243: "Cabbage",
    244: "Cauliflower",
    245: "Celeriac",
    246: "Radishes",
    247: "Turnips",
    248: "Eggplants",
    249: "Gourds",
    250: "Cranberries",
    254: "Barley / Soybeans (double crop)",
}

# Codes that are not farmed.
NOT_FARMED = [0, 63, 64, 65, 81, 82, 83, 87, 88, 111, 112, 121, 122, 123, 124, 131, 141, 142, 143, 152, 176, 190, 195]

# Groups in display order, with their label and codes.
GROUPS = [
    ("orchard", "Orchards & vineyards", [55, 66, 67, 68, 69, 70, 71, 72, 74, 75, 76, 77, 204, 210, 211, 212, 215, 217, 218, 220, 221, 223, 242, 250]),
    ("grain", "Grains & oilseeds", [1, 2, 3, 4, 5, 6, 10, 11, 12, 13, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 38, 39, 45, 51, 52, 53, 60, 205, 224, 225, 226, 228, 230, 232, 233, 234, 235, 236, 237, 238, 239, 240, 241, 254]),
    ("vegetable", "Vegetables & melons", [14, 41, 42, 43, 46, 47, 48, 49, 50, 54, 56, 57, 206, 207, 208, 209, 213, 214, 216, 219, 222, 227, 229, 231, 243, 244, 245, 246, 247, 248, 249]),
    ("forage", "Forage & pasture", [36, 37, 58, 59, 176]),
    ("developed", "Developed", [82, 121, 122, 123, 124]),
    ("forest", "Forest & shrub", [63, 64, 141, 142, 143, 152]),
    ("water", "Water & wetland", [83, 87, 92, 111, 112, 190, 195]),
    ("other", "Other & fallow", [0, 44, 61, 65, 81, 88, 131]),
]

# Drought severity labels; -1 is ground outside every zone.
DROUGHT_LABELS = {
    -1: "No drought",
    0: "D0 — Abnormally dry",
    1: "D1 — Moderate drought",
    2: "D2 — Severe drought",
    3: "D3 — Extreme drought",
    4: "D4 — Exceptional drought",
}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key.cast("int")]


def land_cover_name(code: Column, unknown: bool = False) -> Column:
    """Name of a code; null if unlisted, or ``Unknown (code)`` where ``unknown`` is set."""
    name = _lookup(LEGEND, code)
    return F.coalesce(name, F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")"))) if unknown else name


def is_agricultural(code: Column) -> Column:
    """Whether a code is outside the list of unfarmed ones; an unlisted code counts as farmed."""
    return ~code.isin(NOT_FARMED)


def land_cover_group(code: Column) -> Column:
    """Group id of a code, ``other`` if it belongs to none."""
    return F.coalesce(_lookup({c: g for g, _, codes in GROUPS for c in codes}, code), F.lit("other"))


def group_dimension(spark: SparkSession) -> DataFrame:
    """(group_id, group_label, group_order): one row per group."""
    return spark.createDataFrame([(g, label, i) for i, (g, label, _) in enumerate(GROUPS)], "group_id string, group_label string, group_order int")


def drought_label(code: Column) -> Column:
    return F.coalesce(_lookup(DROUGHT_LABELS, code), F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")")))
