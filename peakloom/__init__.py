"""PySpark-native analytics for tandem mass spectra and peptide identifications."""
