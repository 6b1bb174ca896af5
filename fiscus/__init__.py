"""Public-revenue projection on Spark DataFrames.

The package classifies rows of a monthly accounting fact table into revenue
categories, nets and annualises them, projects them with macro-economic
indices, flags, deflates and publishes the consolidated table.
"""

from fiscus.plans.projection_plan import project_revenue, publishable_revenue
from fiscus.schema import Horizon
from fiscus.sources.parameters import Parameters

__all__ = ["Horizon", "Parameters", "project_revenue", "publishable_revenue"]
