from vertexweave.functions.ids import padded, region_key_width, unsigned_order
from vertexweave.functions.text import strict_int, tokens, trim_control

__all__ = ["padded", "region_key_width", "strict_int", "tokens", "trim_control", "unsigned_order"]
