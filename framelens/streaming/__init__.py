"""The row-wise operators on streams, and windowed counts with a watermark."""
