"""Labels and thresholds of the segmentations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.functions.numbers import as_column, first_match

# Labels shown to users and used as filter values in the named queries.
GMV_MAX = "Max (Top 20%)"
GMV_MIN = "Min (Bottom 20%)"
AOV_MAX = "Max (>20% Avg)"
AOV_MIN = "Min (<-20% Avg)"
MIDDLE = "Middle"
STAR = "Star (High GMV, High Volume)"
HERO = "Hero (High GMV)"
VOLUME = "Volume (High Volume, Low GMV)"
CORE = "Core (Average)"
RISK_HERO = "⚠️ RISK: Over-reliance on hero products"
RISK_CORE = "⚠️ URGENT: Need to push core products"
HEALTHY = "✅ Healthy"
ADS_EXCELLENT = "🚀 Excellent (ROAS ≥ 5)"
ADS_GOOD = "✅ Good (ROAS 3-5)"
ADS_BREAK_EVEN = "⚠️ Break-even (ROAS 1-3)"
ADS_BLEEDING = "🔴 Bleeding (No sales, high clicks)"
ADS_MONITOR = "📊 Needs Monitoring"
LIST_BLEEDING = "🔴 Bleeding (No sales)"


def gmv_segment(gmv, p20, p80) -> Column:
    gmv = as_column(gmv).cast("double")
    return first_match([(gmv >= p80, GMV_MAX), (gmv <= p20, GMV_MIN)], MIDDLE)


def aov_segment(aov, mean) -> Column:
    aov = as_column(aov)
    return first_match([(aov > mean * 1.2, AOV_MAX), (aov < mean * 0.8, AOV_MIN)], MIDDLE)


def product_segment(gmv, quantity, median_gmv, median_quantity, inclusive: bool = False) -> Column:
    """Star, hero, volume or core by the medians; ``inclusive`` counts the median itself as high."""
    gmv, quantity = as_column(gmv).cast("double"), as_column(quantity).cast("double")
    if inclusive:
        high_gmv, high_quantity = gmv >= median_gmv, quantity >= median_quantity
    else:
        high_gmv, high_quantity = gmv > median_gmv, quantity > median_quantity
    return first_match([(high_gmv & high_quantity, STAR), (high_gmv, HERO), (high_quantity, VOLUME)], CORE)


def risk_status(segment, contribution) -> Column:
    segment, contribution = as_column(segment), as_column(contribution)
    return first_match(
        [((segment == HERO) & (contribution > 60), RISK_HERO), ((segment == CORE) & (contribution < 25), RISK_CORE)],
        HEALTHY,
    )


def campaign_health(min_clicks: int = 100) -> Column:
    roas = F.col("ROAS")
    return first_match(
        [
            (roas >= 5, ADS_EXCELLENT),
            (roas >= 3, ADS_GOOD),
            (roas >= 1, ADS_BREAK_EVEN),
            ((F.col("Orders") == 0) & (F.col("Clicks") > min_clicks), ADS_BLEEDING),
        ],
        ADS_MONITOR,
    )


def campaign_list(min_clicks: int = 50) -> Column:
    """List a campaign is shown in; null for one with neither sales nor enough clicks."""
    roas = F.col("ROAS")
    return first_match(
        [
            (roas >= 5, ADS_EXCELLENT),
            (roas >= 3, ADS_GOOD),
            (roas >= 1, ADS_BREAK_EVEN),
            ((F.col("Orders") == 0) & (F.col("Clicks") > min_clicks), LIST_BLEEDING),
            (F.col("Orders") > 0, ADS_MONITOR),
        ],
        None,
    )
