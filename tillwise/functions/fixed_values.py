"""Fixed values of the store data model.

These strings and numbers are part of the data (they are stored in the tables)
or part of the definition of a report, so they must be spelled exactly like
this for results to be right.
"""

from __future__ import annotations

# Order and subscription vocabularies.
PAID_STATUSES = ("complete", "edd_subscription")
REFUNDED = "refunded"
FAILED = "failed"
COMPLETE = "complete"
SALE = "sale"
RENEWAL = "renewal"
PENDING = "pending"
ACTIVE = "active"
ENDED_STATUSES = ("cancelled", "expired")
DISABLED = "disabled"
BILLING = "billing"

# Keys of the attribute tables and the note type that carries attribution text.
PAYMENT_NOTE = "edd_payment_note"
META_BUNDLE = "_edd_bundled_products"
META_COST = "_edd_product_cost"
META_CUSTOMER_IP = "_edd_customer_ip"

# Renewal cohorts: months until renewal, and the value from which a single
# purchase counts as a lifetime deal and leaves the cohort.
RENEWAL_MONTHS = 12
LIFETIME_DEAL_VALUE = 847

# Attribution text -> channel, first match wins.
CHANNELS = (
    ("utm_source=google", "Google"),
    ("utm_source=facebook", "Facebook"),
    ("utm_source=twitter", "Twitter"),
    ("utm_source=email", "Email"),
    ("utm_source=affiliate", "Affiliate"),
    ("referrer", "Referral"),
)
CHANNEL_OTHER = "Direct/Unknown"

# Sales regions by ISO country code.
REGIONS = (
    ("North America", ("US", "CA", "MX")),
    ("Europe", ("GB", "DE", "FR", "IT", "ES", "NL", "BE", "AT", "CH", "SE", "NO", "DK", "FI", "IE", "PT", "PL", "CZ", "GR")),
    ("Asia Pacific", ("AU", "NZ", "SG", "MY", "TH", "ID", "PH", "VN")),
    ("Latin America", ("BR", "AR", "CL", "CO", "PE", "VE", "EC", "UY")),
    ("South Asia", ("IN", "PK", "BD", "LK")),
    ("East Asia", ("CN", "JP", "KR", "TW", "HK")),
    ("Africa", ("ZA", "EG", "KE", "NG", "GH", "TZ", "UG")),
    ("Middle East", ("AE", "SA", "IL", "TR", "IQ", "IR", "JO", "LB", "KW", "QA")),
)
REGION_OTHER = "Other"

# Customer segments, in display order.
RFM_SEGMENTS = (
    "Champions",
    "Loyal Customers",
    "Big Spenders",
    "Recent Customers",
    "At Risk",
    "Lost",
    "Potential",
)

# Spend classes: quantile that opens the class, label; display order.
SPEND_CLASSES = (
    (0.90, "Top 10%"),
    (0.75, "75-90%"),
    (0.50, "50-75%"),
    (0.25, "25-50%"),
)
SPEND_CLASS_REST = "Bottom 25%"

# Days from signup to first purchase: upper bound, label; display order.
FIRST_PURCHASE_CLASSES = (
    (1, "1 Day"),
    (7, "2-7 Days"),
    (30, "8-30 Days"),
    (90, "31-90 Days"),
)
FIRST_PURCHASE_SAME_DAY = "Same Day"
FIRST_PURCHASE_REST = "90+ Days"

# Anonymised values.
ANON_EMAIL_PREFIX = "anon_"
ANON_EMAIL_DOMAIN = "@localhost.dev"
ANON_NAME_PREFIX = "Customer_"
ANON_NETWORK = "192.168."
