"""The industry code dimension and expressions over code columns.

Codes are text: sectors such as ``31-33`` span several two-digit members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.functions.text import strip
from sectorscope.operators.sizing import local_table

# Public NAICS two-digit sectors, in list order.
# (code, long description, medium description, short description); the last two exist for
# the 19 classes a classifier is trained on.
SECTORS = [
    ("11", "Agriculture, Forestry, Fishing and Hunting", "Agriculture, Forestry, Fishing and Hunting", "Agriculture"),
    ("21", "Mining, Quarrying, and Oil and Gas Extraction", "Mining, Quarrying, Oil and Gas Extraction", "Mining"),
    ("22", "Utilities", "Utilities", "Utilities"),
    ("23", "Construction", "Construction", "Construction"),
    ("31", "Manufacturing", None, None),
    ("32", "Manufacturing", None, None),
    ("33", "Manufacturing", None, None),
    ("31-33", "Manufacturing", "Manufacturing", "Manufacturing"),
    ("42", "Wholesale Trade", "Wholesale Trade", "Wholesale Trade"),
    ("44", "Retail Trade", None, None),
    ("45", "Retail Trade", None, None),
    ("44-45", "Retail Trade", "Retail Trade", "Retail Trade"),
    ("48", "Transportation and Warehousing", None, None),
    ("49", "Transportation and Warehousing", None, None),
    ("48-49", "Transportation and Warehousing", "Transportation and Warehousing", "Transportation"),
    ("51", "Information", "Information", "Information"),
    ("52", "Finance and Insurance", "Finance and Insurance", "Finance"),
    ("53", "Real Estate and Rental and Leasing", "Real Estate and Rental", "Real Estate"),
    ("54", "Professional, Scientific, and Technical Services", "Professional, Scientific, Technical Services", "Professional Services"),
    ("55", "Management of Companies and Enterprises", None, None),
    ("56", "Administrative and Support and Waste Management Services", "Administrative and Support Services", "Admin Services"),
    ("61", "Educational Services", "Educational Services", "Education"),
    ("62", "Health Care and Social Assistance", "Health Care and Social Assistance", "Healthcare"),
    ("71", "Arts, Entertainment, and Recreation", "Arts, Entertainment, and Recreation", "Entertainment"),
    ("72", "Accommodation and Food Services", "Accommodation and Food Services", "Accommodation"),
    ("81", "Other Services (except Public Administration)", "Other Services", "Other Services"),
    ("92", "Public Administration", "Public Administration", "Public Admin"),
]

ALL_CODES = [row[0] for row in SECTORS]
PRIMARY_CODES = [c for c in ALL_CODES if "-" not in c]
_MEMBERS = {str(m) for c in ALL_CODES if "-" in c for m in range(int(c[:2]), int(c[3:]) + 1)}
SECTOR_CODES = [c for c in ALL_CODES if c not in _MEMBERS]
CLASS_CODES = [row[0] for row in SECTORS if row[2] is not None]

SECTOR_DIM_SCHEMA = (
    "code string, seq int, long_desc string, medium_desc string, short_desc string, "
    "is_primary boolean, is_sector boolean, is_class boolean"
)


def sector_dim(spark: SparkSession) -> DataFrame:
    """The code dimension as a table: 27 rows by construction, safe to broadcast."""
    rows = [
        (code, seq, long, medium, short, code in PRIMARY_CODES, code in SECTOR_CODES, code in CLASS_CODES)
        for seq, (code, long, medium, short) in enumerate(SECTORS)
    ]
    return local_table(spark, rows, SECTOR_DIM_SCHEMA)


def normalize_code(col: Column) -> Column:
    """Trim; keep ranges; shorten anything else to its first two characters."""
    code = strip(col)
    return F.when((F.length(code) > 2) & ~F.contains(code, F.lit("-")), F.left(code, F.lit(2))).otherwise(code)


def is_valid_code(col: Column) -> Column:
    """True when the trimmed text is a known code; null is not."""
    return F.coalesce(strip(col).isin(ALL_CODES), F.lit(False))
