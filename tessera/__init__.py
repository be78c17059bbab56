"""A Spark-native medallion engine: Bronze ingestion, Silver validation, Gold features and a property graph."""

from .graph.loader import GraphLoader
from .operators.cleaning import SilverCleaner
from .plans.bronze import BronzeIngester
from .plans.gold import GoldProcessor
from .plans.silver import SilverProcessor

__all__ = ["BronzeIngester", "GoldProcessor", "GraphLoader", "SilverCleaner", "SilverProcessor"]
