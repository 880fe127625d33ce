"""signalframe: sensor-table and waveform diagnostics as Spark DataFrame jobs."""
