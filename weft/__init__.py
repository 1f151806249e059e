"""weft: analytics for particle-simulation tables, written as DataFrame plans."""
