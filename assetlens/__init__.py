"""assetlens: asset registers, versioned parameter sheets and positioned document text on Spark."""
