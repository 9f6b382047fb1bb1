"""lapse: customer-attrition analytics on Spark DataFrames."""

from lapse.spec import Spec, SpecError  # noqa: F401

__version__ = "0.1.0"
