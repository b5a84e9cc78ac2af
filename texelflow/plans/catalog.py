"""Formats, targets and flags by name."""

from __future__ import annotations

#: Block sizes of the LDR formats in code order, and all targets.
XUASTC_SIZES = ("4x4", "5x4", "5x5", "6x5", "6x6", "8x5", "8x6", "10x5", "10x6", "8x8", "10x8", "10x10", "12x10", "12x12")
PIXELS = ("RGBA8", "RGB565", "BGR565", "RGBA4444")
BLOCKS = ("ETC1", "ETC2", "ETC2_NO_ALPHA", "ETC2_EAC_R11", "ETC2_EAC_RG11", "BC1", "BC3", "BC4", "BC5", "BC7")
HDR = ("BC6H", "RGB_HALF", "RGBA_HALF", "RGB_9E5")
TARGETS = ("ASTC_HDR_4X4", "ASTC_HDR_6X6", *(f"ASTC_LDR_{s.upper()}" for s in XUASTC_SIZES), *HDR, *BLOCKS, *PIXELS)
#: name, bit
DECODE_FLAGS = (("pvrtc_next_pow2", 2), ("alpha_to_opaque", 4), ("bc1_no_three_colours", 8), ("alpha_indices", 16), ("high_quality", 32), ("no_etc1s_chroma_filter", 64), ("no_deblock", 128), ("stronger_deblock", 256), ("force_deblock", 512), ("no_fast_bc7", 1024))
