"""Column functions: text analysis, stemming, posting and dictionary codecs."""
