"""Keyword lists per industry, and the term lists of the tagging rules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "default"

# The search keywords of each industry, in search order.
INDUSTRY_KEYWORDS = {
    "default": [
        "Expansion of Agricultural Lands", "Wildfires", "Loss of Biodiversity",
        "Decreased Water Levels", "Water Contamination", "Water Conservation Practices",
        "Forest Fires", "Aquatic Ecosystem Disturbances", "CO2 Emissions", "Air Quality",
        "Deforestation", "Unsustainable Sourcing", "Habitat Destruction", "Pollution",
        "Greenhouse Gas Emissions", "Drought", "Community grievances",
        "Discrimination lawsuits", "Forced evictions and resettlement", "Unethical labor",
        "Labor strikes and protests", "Wage exploitation", "Human rights violations",
        "Violence or harassment lawsuits", "Prohibition of off-label products use",
        "Product withdrawal or recall", "Consumer court cases", "Excessive working hours",
        "Rising food prices", "Loss of cultural identity", "Social unrest and tension",
        "Protests and opposition", "Unsafe working conditions", "Inadequate living conditions",
        "Gender inequality", "Human trafficking", "Poor Board Accountability",
        "Supply Chain Management Issues", "Product Inaccessibility and Unaffordability",
        "Bribery and Kickbacks", "Whistleblowing Policy", "Corruption Scandals",
        "Discrimination and Harassment Claims", "Conflict of Interest", "Legal Non-Compliance",
        "Fraud", "Damage to Brand or Reputation", "Consumer Data Breaches",
        "Major Cybersecurity Breaches",
    ],
    "Retail": [
        "Loss of Biodiversity", "Water Conservation Practices", "CO2 Emissions",
        "Recycling Initiatives", "Environmental Policies", "Eco-friendly Packaging",
        "Green Building Certifications", "Pollution", "Greenhouse Gas Emissions",
        "Unsustainable Sourcing", "Drought", "Discrimination lawsuits", "LGBTQIA+ oppose",
        "Forced evictions and resettlement", "Unethical labor", "Labor strikes and protests",
        "Wage exploitation", "Human rights violations", "Violence or harassment lawsuits",
        "Excessive working hours", "Income disparity", "Signs of a breakdown in community",
        "Social unrest and tension", "Unequal distribution of benefits",
        "Protests and opposition", "Unsafe working conditions", "Inadequate living conditions",
        "Human trafficking", "High turnover rate", "Gender inequality",
        "Consumer Data Breaches", "Supply Chain Management Issues",
        "Product Inaccessibility and Unaffordability", "Competition Related Lawsuits",
        "IP Related Lawsuits", "Whistleblowing Policy", "Corruption Scandals",
        "Anti-Competitive Practices", "Discrimination and Harassment Claims",
        "Supplier or Vendor Personal Relationships", "Insider Information",
        "Opaque Financial Transactions", "Major Cybersecurity Breaches", "Financial Scandals",
        "Damage to Brand or Reputation", "Conflict of Interest", "Legal Non-Compliance",
        "Fraud", "Financial Crime",
    ],
    "Automotive": [
        "CO2 Emissions", "Air Quality", "Recycling Initiatives", "Environmental Policies",
        "Greenhouse Gas Emissions", "Pollution", "Water Contamination",
        "Excessive Extraction of Non-Renewable Resources", "Chemical Leak",
        "Unsustainable Sourcing", "Community grievances", "Discrimination lawsuits",
        "Labor strikes and protests", "Wage exploitation", "Human rights violations",
        "Violence or harassment lawsuits", "Cybersecurity crimes",
        "Product withdrawal or recall", "Job losses", "Consumer court cases",
        "Excessive working hours", "Violations of labor laws", "Social unrest and tension",
        "Unsafe working conditions", "Inadequate living conditions", "High turnover rate",
        "Gender inequality", "Supply Chain Management issues",
        "Product Inaccessibility and Unaffordability", "Consumer Data Breaches",
        "Government lobbying", "Major Cybersecurity Breaches", "Bribery and Kickbacks",
        "Whistleblowing Policy", "Corruption Scandals", "Anti-Competitive Practices",
        "Damage to brand or reputation", "Conflict of interest", "Legal non-compliance",
    ],
    "Consumer Goods": [
        "Loss of Biodiversity", "Water Contamination", "CO2 Emissions", "Recycling Initiatives",
        "Environmental Policies", "Water Conservation Practices", "Pollution",
        "Eco-friendly Packaging", "Deforestation", "Unsustainable Sourcing",
        "Greenhouse Gas Emissions", "Chemical Leak", "Habitat Destruction",
        "Community grievances", "Discrimination lawsuits", "Unethical Labor",
        "Labor Strikes and protests", "Wage Exploitation", "Product withdrawal or recall",
        "Consumer court cases", "Unsafe Working Conditions", "Inadequate Living Conditions",
        "High turnover rate", "Gender Inequality", "Violations of Labor Laws",
        "Social Unrest and Tension", "Rising Food Prices", "Cybersecurity crimes",
        "Consumer Data Breaches", "Supply Chain Management Issues",
        "Product Inaccessibility and Unaffordability", "Discrimination and Harassment Claims",
        "Whistleblowing Policy", "Major Cybersecurity Breaches",
        "Damage to Brand or Reputation", "Corruption Scandals", "Bribery and Kickbacks",
        "Conflict of Interest", "Legal Non-Compliance", "Fraud",
    ],
    "Healthcare": [
        "Water Contamination", "CO2 Emissions", "Poor Water Conservation Practices",
        "Poor Air Quality", "Recycling Initiatives Failure", "Lack of Environmental Policies",
        "Pollution", "Lack of Eco-friendly Packaging", "Green Building Certifications Failure",
        "Greenhouse gas emissions", "Chemical leak", "Community grievances",
        "Discrimination lawsuits", "LGBTQIA+ oppose", "Unethical labor",
        "Violence or harassment lawsuits", "Cybersecurity crimes",
        "Prohibition of off-label products use", "Product withdrawal or recall",
        "Consumer court cases", "Excessive working hours", "Unsafe working conditions",
        "Human trafficking", "High turnover rate", "Gender inequality",
        "Consumer Data Breaches", "Supply Chain Management issues",
        "Product Inaccessibility and Unaffordability", "Whistleblowing Policy",
        "Corruption Scandals", "Discrimination and Harassment Claims", "Insider Information",
        "Major Cybersecurity Breaches", "Financial Scandals", "Damage to brand or reputation",
        "Conflict of interest", "Legal non-compliance", "Fraud", "Financial Crime",
    ],
    "Hospitality": [
        "Poor Water Conservation Practices", "Water Contamination",
        "Lack of Recycling Initiatives", "Environmental Policies Failure",
        "Non-Eco-friendly Packaging", "Green Building Certifications Failure", "Pollution",
        "Deforestation", "Greenhouse Gas Emissions", "Unsustainable Sourcing", "Wildfires",
        "Loss of Biodiversity", "Community grievances", "Discrimination lawsuits",
        "LGBTQIA+ oppose", "Forced evictions and resettlement", "Unethical Labor",
        "Labor Strikes and protests", "Wage Exploitation", "Human rights violations",
        "Violence or harassment lawsuits", "Excessive Working Hours",
        "Loss of Skills and Expertise", "Violations of Labor Laws",
        "Signs of a breakdown in community", "Social Unrest and Tension",
        "Unequal Distribution of Benefits", "Protests and Opposition",
        "Unsafe Working Conditions", "Inadequate Living Conditions", "Human Trafficking",
        "High turnover rate", "Gender Inequality", "Consumer Data Breaches",
        "Supply Chain Management issues", "Product Inaccessibility and Unaffordability",
        "Whistleblowing Policy", "Corruption Scandals", "Anti-Competitive Practices",
        "Discrimination and Harassment Claims", "Supplier or Vendor Personal Relationships",
        "Insider Information", "Major Cybersecurity Breaches", "Damage to brand or reputation",
        "Conflict of interest", "Legal non-compliance", "Fraud", "Financial Crime",
        "Illegal Financing", "Sanctioned",
    ],
    "Real Estate": [
        "Green Building Certifications Failure", "CO2 Emissions", "Deforestation",
        "Habitat Destruction", "Loss of Biodiversity", "Flood", "Drought", "Poor Air Quality",
        "Pollution", "Water Contamination", "Decreased Water Levels",
        "Water Conservation Practices", "Environmental Policies", "Recycling Initiatives",
        "Greenhouse Gas Emissions", "Community grievances", "Forced evictions and resettlement",
        "Inadequate Living Conditions", "Human rights violations", "Loss of Cultural Identity",
        "Signs of a breakdown in community", "Social Unrest and Tension",
        "Unequal Distribution of Benefits", "Protests and Opposition",
        "Discrimination lawsuits", "Gender Inequality", "Unsafe Working Conditions",
        "Violations of Labor Laws", "Unethical Labor", "Poor Board Accountability",
        "Consumer Data Breaches", "Supply Chain Management issues",
        "Product Inaccessibility and Unaffordability", "Money Laundering",
        "Government Lobbying", "Bribery and Kickbacks", "Whistleblowing Policy",
        "Corruption Scandals", "Discrimination and Harassment Claims", "Insider Information",
        "Opaque Financial Transactions", "Major Cybersecurity Breaches", "Financial Scandals",
        "Damage to Brand or Reputation", "Conflict of Interest", "Legal Non-Compliance",
    ],
    "Telecom": [
        "CO2 Emissions", "Air Quality", "Recycling Initiatives", "Environmental Policies",
        "Greenhouse Gas Emissions", "Pollution", "Eco-friendly Packaging",
        "Green Building Certifications", "Drought",
        "Excessive extraction of non-renewable resources", "Chemical Leak",
        "Community grievances", "Cybersecurity crimes", "Consumer court cases", "Job Losses",
        "Excessive Working Hours", "Violations of Labor Laws", "Unethical Labor",
        "Labor Strikes and Protests", "Wage Exploitation", "Gender Inequality",
        "Violence or Harassment Lawsuits", "Discrimination Lawsuits",
        "Social Unrest and Tension", "Unequal Distribution of Benefits",
        "Protests and Opposition", "Consumer Data Breaches", "Supply Chain Management Issues",
        "Major Cybersecurity Breaches", "Competition-Related Lawsuits", "IP-Related Lawsuits",
        "Government Lobbying", "Bribery and Kickbacks", "Whistleblowing Policy",
        "Anti-Competitive Practices", "Discrimination and Harassment Claims",
        "Corruption Scandals", "Legal Non-Compliance", "Damage to Brand or Reputation",
        "Conflict of Interest",
    ],
    "Transport": [
        "CO2 Emissions", "Air Quality", "Pollution", "Greenhouse Gas Emissions",
        "Water Contamination", "Non-Implementation of Environmental Policies",
        "Lack of Recycling Initiatives", "Chemical Leak", "Habitat Destruction",
        "Labor Strikes and Protests", "Unsafe Working Conditions", "Excessive Working Hours",
        "Wage Exploitation", "Violations of Labor Laws", "Inadequate Living Conditions",
        "Job Losses", "High Turnover Rate", "Discrimination Lawsuits",
        "Violence or Harassment Lawsuits", "Gender Inequality", "Human Trafficking",
        "Community Grievances", "Social Unrest and Tension", "Protests and Opposition",
        "Loss of Cultural Identity", "Unequal Distribution of Benefits", "Consumer Court Cases",
        "Supply Chain Management issues", "Consumer Data Breaches", "Whistleblowing Policy",
        "Bribery and Kickbacks", "Corruption Scandals", "Major Cybersecurity Breaches",
        "Damage to brand or reputation", "Conflict of interest", "Legal non-compliance",
        "Fraud", "Financial Crime", "Discrimination and Harassment Claims",
    ],
    "Metals": [
        "Loss of Biodiversity", "Decreased Water Levels", "Water Contamination",
        "CO2 Emissions", "Air Quality", "Aquatic Ecosystem Disturbances",
        "Excessive extraction of non-renewable resources", "Habitat Destruction", "Pollution",
        "Deforestation", "Greenhouse Gas Emissions", "Chemical Leak", "Unsustainable Sourcing",
        "Drought", "Community grievances", "Forced evictions and resettlement",
        "Unethical Labor", "Labor Strikes and protests", "Wage Exploitation",
        "Human rights violations", "Violence or harassment lawsuits", "Excessive Working Hours",
        "Loss of Cultural Identity", "Violations of Labor Laws",
        "Signs of a breakdown in community", "Social Unrest and Tension",
        "Unequal Distribution of Benefits", "Protests and Opposition",
        "Unsafe Working Conditions", "Inadequate Living Conditions", "Human Trafficking",
        "High turnover rate", "Gender Inequality", "Poor Board Accountability",
        "Supply Chain Management Issues", "Money Laundering", "Criminal Directors/Executives",
        "Bribery and Kickbacks", "Corruption Scandals", "Anti-Competitive Practices",
        "Insider Information", "Opaque Financial Transactions", "Major Cybersecurity Breaches",
        "Financial Scandals", "Damage to Brand or Reputation", "Conflict of Interest",
        "Legal Non-Compliance", "Fraud", "Financial Crime", "Illegal Financing", "Sanctioned",
    ],
}

# Keyword file stem -> industry label.
FILE_LABELS = {
    "news_search": DEFAULT,
    "retail": "Retail",
    "automotive": "Automotive",
    "consumer": "Consumer Goods",
    "healthcare": "Healthcare",
    "hospitality": "Hospitality",
    "real_estate": "Real Estate",
    "telecom": "Telecom",
    "transport": "Transport",
    "metals": "Metals",
}

# Terms that point to one ESG pillar. Ties go to the pillar named first.
PILLAR_TERMS = {
    "Environmental": [
        "climate", "climate change", "carbon emissions", "co2 emissions", "emissions",
        "renewable energy", "pollution", "conservation", "deforestation", "biodiversity",
        "drought", "water contamination", "chemical leak", "industrial discharges",
    ],
    "Social": [
        "human rights", "labor", "labor conditions", "diversity", "equity", "inclusion",
        "health and safety", "working conditions", "child labor", "forced labor",
        "human trafficking", "gender inequality", "discrimination", "community involvement",
    ],
    "Governance": [
        "governance", "transparency", "accountability", "ethics", "compliance",
        "non compliance", "risk management", "executive remuneration",
        "executive compensation", "shareholder rights", "corruption", "fraud", "bribery",
        "off label products",
    ],
}

# Terms that count for or against a company; callers normally bring their own table.
POLARITY_TERMS = {
    1: ["improve", "improved", "award", "progress", "renewable energy", "reduced"],
    -1: [
        "unsafe", "corruption", "fraud", "pollution", "trafficking", "scandals", "unethical",
        "non compliance", "violations", "lawsuits",
    ],
}

# Terms that make a sentence count as an incident.
INCIDENT_TERMS = [
    "chemical leak", "corruption scandals", "cybersecurity breaches", "data breaches",
    "financial crime", "fraud", "human trafficking", "legal non compliance", "money laundering",
    "pollution", "product withdrawal or recall", "unsafe working conditions",
]

# Words that carry no meaning of their own; dropped before a sentence is scored.
STOP_WORDS = (
    "i me my we our you your he him his she her it its they them their this that these those "
    "am is are was were be been being have has had do does did a an the and but if or because "
    "as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()


def quoted(text: str) -> str:
    """An SQL string literal that Spark and other engines read alike."""
    return "'" + text.replace("'", "''") + "'"


def keyword_values(keywords: dict[str, list[str]] | None = None) -> str:
    """The keyword lists as one SQL ``VALUES`` query (industry, pos, keyword)."""
    rows = ", ".join(
        f"({quoted(industry)}, {pos}, {quoted(word)})"
        for industry, words in (keywords or INDUSTRY_KEYWORDS).items()
        for pos, word in enumerate(words)
    )
    return f"SELECT * FROM (VALUES {rows}) AS lex(industry, pos, keyword)"


def keyword_table(spark: SparkSession, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """The built-in lists. A local relation, so Spark knows that it is small."""
    return spark.sql(keyword_values(keywords))


def constant(value: list | dict, type_name: str) -> Column:
    """A Python value as one literal; Spark folds the parsing away before it runs."""
    return F.from_json(F.lit(json.dumps(value)), type_name)


def text_array(values: list[str]) -> Column:
    return constant(values, "array<string>")
