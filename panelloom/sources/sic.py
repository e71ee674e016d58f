"""SIC major groups: the public industry dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Codes and names of the public OSHA SIC manual.
MAJOR_GROUPS = """
Division A: Agriculture, Forestry, And Fishing
01 Agricultural Production Crops
02 Agriculture Production Livestock And Animal Specialties
07 Agricultural Services
08 Forestry
09 Fishing, Hunting, And Trapping
Division B: Mining
10 Metal Mining
12 Coal Mining
13 Oil And Gas Extraction
14 Mining And Quarrying Of Nonmetallic Minerals, Except Fuels
Division C: Construction
15 Building Construction General Contractors And Operative Builders
16 Heavy Construction Other Than Building Construction Contractors
17 Construction Special Trade Contractors
Division D: Manufacturing
20 Food And Kindred Products
21 Tobacco Products
22 Textile Mill Products
23 Apparel And Other Finished Products Made From Fabrics And Similar Materials
24 Lumber And Wood Products, Except Furniture
25 Furniture And Fixtures
26 Paper And Allied Products
27 Printing, Publishing, And Allied Industries
28 Chemicals And Allied Products
29 Petroleum Refining And Related Industries
30 Rubber And Miscellaneous Plastics Products
31 Leather And Leather Products
32 Stone, Clay, Glass, And Concrete Products
33 Primary Metal Industries
34 Fabricated Metal Products, Except Machinery And Transportation Equipment
35 Industrial And Commercial Machinery And Computer Equipment
36 Electronic And Other Electrical Equipment And Components, Except Computer Equipment
37 Transportation Equipment
38 Measuring, Analyzing, And Controlling Instruments; Photographic, Medical And Optical Goods; Watches And Clocks
39 Miscellaneous Manufacturing Industries
Division E: Transportation, Communications, Electric, Gas, And Sanitary Services
40 Railroad Transportation
41 Local And Suburban Transit And Interurban Highway Passenger Transportation
42 Motor Freight Transportation And Warehousing
43 United States Postal Service
44 Water Transportation
45 Transportation By Air
46 Pipelines, Except Natural Gas
47 Transportation Services
48 Communications
49 Electric, Gas, And Sanitary Services
Division F: Wholesale Trade
50 Wholesale Trade-durable Goods
51 Wholesale Trade-non-durable Goods
Division G: Retail Trade
52 Building Materials, Hardware, Garden Supply, And Mobile Home Dealers
53 General Merchandise Stores
54 Food Stores
55 Automotive Dealers And Gasoline Service Stations
56 Apparel And Accessory Stores
57 Home Furniture, Furnishings, And Equipment Stores
58 Eating And Drinking Places
59 Miscellaneous Retail
Division H: Finance, Insurance, And Real Estate
60 Depository Institutions
61 Non-depository Credit Institutions
62 Security And Commodity Brokers, Dealers, Exchanges, And Services
63 Insurance Carriers
64 Insurance Agents, Brokers, And Service
65 Real Estate
67 Holding And Other Investment Offices
Division I: Services
70 Hotels, Rooming Houses, Camps, And Other Lodging Places
72 Personal Services
73 Business Services
75 Automotive Repair, Services, And Parking
76 Miscellaneous Repair Services
78 Motion Pictures
79 Amusement And Recreation Services
80 Health Services
81 Legal Services
82 Educational Services
83 Social Services
84 Museums, Art Galleries, And Botanical And Zoological Gardens
86 Membership Organizations
87 Engineering, Accounting, Research, Management, And Related Services
88 Private Households
89 Miscellaneous Services
Division J: Public Administration
91 Executive, Legislative, And General Government, Except Finance
92 Justice, Public Order, And Safety
93 Public Finance, Taxation, And Monetary Policy
94 Administration Of Human Resource Programs
95 Administration Of Environmental Quality And Housing Programs
96 Administration Of Economic Programs
97 National Security And International Affairs
99 Nonclassifiable Establishments
"""


def rows() -> list[tuple[str, str, str]]:
    """(sic2, industry, division)."""
    out, division = [], ""
    for line in MAJOR_GROUPS.strip().splitlines():
        if line.startswith("Division"):
            division = line
        else:
            out.append((line[:2], line[3:], division))
    return out


def sic_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "sic2 string, industry string, division string")
