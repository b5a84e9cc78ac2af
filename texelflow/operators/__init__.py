"""DataFrame operators over slices, blocks and texels."""
