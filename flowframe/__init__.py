"""flowframe: DataFrame-to-DataFrame operators over streams of timestamped records and byte buffers."""
