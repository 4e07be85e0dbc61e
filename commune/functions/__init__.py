from commune.functions.ip import ip_to_long, ip_to_long_unchecked, is_ipv4, long_to_ip
from commune.functions.score import ceil_score, reported_score
from commune.functions.text import state_text

__all__ = [
    "ceil_score", "reported_score",
    "ip_to_long", "ip_to_long_unchecked", "is_ipv4", "long_to_ip", "state_text",
]
