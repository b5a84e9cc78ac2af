"""Column functions over texels, codes and bits; all stay inside the JVM."""
