"""Business constants that results must reproduce exactly.

Everything in this module is data, not logic.
"""

# State name -> two-letter code.
STATE_CODES = {
    "Delhi": "DL",
    "Maharashtra": "MH",
    "Uttar Pradesh": "UP",
    "Gujarat": "GJ",
    "Rajasthan": "RJ",
    "Kerala": "KL",
    "Punjab": "PB",
    "Karnataka": "KA",
    "Madhya Pradesh": "MP",
    "Odisha": "OR",
    "Chandigarh": "CH",
    "West Bengal": "WB",
    "Sikkim": "SK",
    "Andhra Pradesh": "AP",
    "Assam": "AS",
    "Jammu and Kashmir": "JK",
    "Puducherry": "PY",
    "Uttarakhand": "UK",
    "Himachal Pradesh": "HP",
    "Tamil Nadu": "TN",
    "Goa": "GA",
    "Telangana": "TG",
    "Chhattisgarh": "CG",
    "Jharkhand": "JH",
    "Bihar": "BR",
}

# Union territories.
UNION_TERRITORIES = ["Delhi", "Chandigarh", "Puducherry", "Jammu and Kashmir"]

# Fixed values: (state, city) pairs counted as capital cities.
CAPITAL_CITIES = [
    ("Delhi", "New Delhi"),
    ("Maharashtra", "Mumbai"),
    ("Karnataka", "Bengaluru"),
    ("Telangana", "Hyderabad"),
    ("Tamil Nadu", "Chennai"),
]

# City tiers; any other city is Tier-3.
TIER_1_CITIES = [
    "Mumbai", "Delhi", "Bengaluru", "Hyderabad", "Chennai", "Kolkata", "Pune", "Ahmedabad",
]
TIER_2_CITIES = [
    "Jaipur", "Lucknow", "Kanpur", "Nagpur", "Indore", "Bhopal", "Patna", "Vadodara", "Coimbatore",
    "Ludhiana", "Agra", "Nashik", "Ranchi", "Meerut", "Raipur", "Guwahati", "Chandigarh",
]

# State names stored under another name.
STATE_REWRITES = {"Delhi": "New Delhi"}

# Flag spellings, compared in upper case.
ACTIVE_WORDS = ["Y", "YES", "TRUE", "1", "ACTIVE"]
INACTIVE_WORDS = ["N", "NO", "FALSE", "0", "INACTIVE"]
AVAILABLE_WORDS = ["Y", "YES", "TRUE", "1", "AVAILABLE"]
UNAVAILABLE_WORDS = ["N", "NO", "FALSE", "0", "UNAVAILABLE"]

# Masking constants per tag.
MASK_TOKENS = {"PII": "** PII **", "EMAIL": "** EMAIL **", "PHONE": "** Phone **"}

# Month labels in calendar order.
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Fixed value: order status that counts as revenue.
DELIVERED = "Delivered"
