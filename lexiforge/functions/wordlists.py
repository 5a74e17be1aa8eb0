"""Default morpheme dictionaries. Every function that uses one takes it as a parameter."""

# The inflexions of the default dictionary (the empty one is added when it is used).
INFLEXIONS = """
а ам ами ас ах аю ая е ев ее ей ем еми ему емя ешь его ет ете ех ею её и ие ий им ими ит ите их ишь
ию ия м ми мя о ов ого ое ой ом ому ою оё ст ти ть у ум умя ут ух ую шь ы ые ый ым ыми ыт ыте ых ышь
ыю ыя ю ют юю я яя ях ям ями ё ёв ёй ём ёт ёте ёх ёшь ёю йте й
""".split()

# The suffixes of the default dictionary, as written; soft and hard signs go when it is used.
SUFFIXES = """
а абельн ав аж айш ал альн ан ант ану ар арн арь аст ат атор атори аци ач ашн ащ ающ б бищ в ва вш
диил е ебн ев ева евич евн ее ез ейш ем ен ени енн ент енци ень еньк енько ер еск есс еств ец еч ечк
и ив ива ивн ид иден из изм ик ил илк им ин инк ир ист ит ительн их иц ич ича ическ ичк ичн ишк ишн
ищ к ка л лив менн н ни ник ниц нича нн ну нь няк о об ов ова оват ович овн оз озн оид ок ол ом он
онк онн онок онько ор орн ость от оч очк очн ош ск ств сть т тел тель тельн ти у уг ум ун ур ух уч
ущ ци ч чан чат чив чик чин чонок ш ше щ щик щин щиц ыва ыг ыш ышек юг юшк ющ я яв яг янн янт ярн ят
ятин ятор яци ящ ён ённ ёнок ёр
""".split()
