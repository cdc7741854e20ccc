"""Word lists, phrases, patterns and tables that scores are defined by."""

from __future__ import annotations

from math import exp

from .label_rules import LABEL_RULES  # noqa: F401 - the patterns of each label

CATEGORIES: dict[str, tuple[str, ...]] = {
    "authority": ("expert", "experts", "official", "officials", "government", "doctor", "doctors", "scientist", "scientists", "guaranteed", "certified", "proven"),
    "social_proof": ("everyone", "thousands", "millions", "trending", "viral", "bestseller", "bestsellers", "testimonials", "consensus", "majority", "crowd"),
    "scarcity": ("limited", "rare", "exclusive", "handcrafted", "small-batch", "collectible", "once-in-a-lifetime", "restricted", "shortage", "vanishing", "low-stock", "while-supplies-last", "sold-out", "member-only"),
    "urgency": ("hurry", "rush", "deadline", "expiring", "immediately", "limited-time", "last-chance", "act-now", "don't-wait"),
    "emotional_appeal": ("fear", "shocking", "miracle", "incredible", "tragic", "desperate", "heartwarming", "devastating", "thrilling", "terrifying"),
    "expertise_signaling": ("sophisticated", "cutting-edge", "state-of-the-art", "revolutionary", "revolutionaries", "patented", "breakthrough", "breakthroughs", "proprietary", "paradigm", "holistic", "synergy"),
}
PHRASES: dict[str, tuple[str, ...]] = {
    "semantic_traps": ("not but", "instead of", "rather than", "on the other hand"),
    "template_fitting": ("as an ai", "my purpose is", "according to my instructions", "it is important to remember", "please note that", "i cannot", "i am programmed to"),
}
NEGATIONS = ("not", "no", "never", "none", "neither", "nor", "hardly", "scarcely", "barely", "doesn't", "isn't", "wasn't", "shouldn't", "won't", "don't")
#: Tokens after a negation that it covers.
NEGATION_REACH = 6
SUBSTRINGS = ("ignore previous", "disregard", "you are now", "simulate", "pretend", "act as", "bypass", "override", "developer mode", "jailbreak")
#: Code points of Unicode White_Space, and a class of them for Java's and RE2's expressions.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE_JAVA = "[" + "".join(f"\\u{c:04x}" for c in SPACES) + "]+"
SPACE_RE2 = "[" + "".join(f"\\x{{{c:04x}}}" for c in SPACES) + "]+"

ERROR_CODES = {"DepthExceeded": -1, "CognitiveInstability": -2, "BiasHaloDetected": -3, "HallucinationDetected": -4, "ResourceExhaustion": -5, "SelfMemoryExceeded": -6, "DeadlineExceeded": -7}
ERROR_MESSAGES = {
    -1: "reasoning cascade depth exceeded",
    -2: "cognitive entropy exceeds instability pressure threshold",
    -3: "bias halo signal detected in perceptual input",
    -4: "surprise level exceeds hallucination threshold",
    -5: "RSS memory exceeds configured safety ceiling",
    -6: "self memory exceeded",
    -7: "deadline exceeded",
}

#: The logistic function at 256 places from -8 to 0, to six decimals.
SIGMOID = tuple(round(1 / (1 + exp(8 - 8 * i / 255)), 6) for i in range(256))


def sql_list(values, of=lambda v: "'" + v.replace("'", "''") + "'") -> str:
    return ", ".join(of(v) for v in values)
