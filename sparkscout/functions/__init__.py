"""Column-expression helpers: labels and markup, scores, narrative text."""

from .labels import item_label, items_label, markup_to_html, readable_label, title_case
from .narrative import narrate
from .scoring import confidence_score, impact_score, novelty_score, score

__all__ = ["readable_label", "title_case", "item_label", "items_label", "markup_to_html",
           "narrate", "score", "confidence_score", "novelty_score", "impact_score"]
